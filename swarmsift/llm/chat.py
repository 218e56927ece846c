"""Chat formatting by schema fingerprints (DataFrame functions only).

Each record is a JSON object of unknown layout.  The nested field paths of an
object that occur in any known mapping are sorted, joined and hashed; that
fingerprint selects a declarative mapping, which yields canonical turns
``array<struct<role, text>>``.  Fields no mapping mentions do not change the
fingerprint.  Layouts without a mapping give null turns and layout null and
can be listed with ``unknown_layouts``; they are never guessed at.

Template: each turn is ``<|turn|>role<|text|>text<|end|>``.  Inside roles and
texts a backslash follows each backslash and each character that opens a
control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), so no
control string survives there; removing a lone backslash and halving a pair
restores the text.

Defined results: null role or text: empty string; null or malformed JSON, or
one that is no object: null turns; rows of one conversation with equal turn
are ordered by role, then text; null turn sorts last; a repeated row is a turn
of its own; null conversation ids form one conversation; an empty table gives
an empty result; extra columns, whatever their names, are not read by
``format_turns``.  One conversation is one output string, so its turns meet in
one row; its size is the size of that string, and positions and cuts are made
in blocks of turns, so that work does not grow with the square of the turns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, let, running

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = r"\\|<(?=\||/?s>)|\[(?=/?INST\])"


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths that make up its fingerprint and where turns are.

    ``items`` is the array of messages with its role and text fields; or
    ``fixed`` lists (role, path) turns of a flat record; or ``role_path`` and
    ``text_path`` name the fields of a single turn.
    """

    name: str
    paths: tuple[str, ...]
    items: str | None = None
    role_field: str | None = None
    text_field: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    role_path: str | None = None
    text_path: str | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)


ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), "messages", "role", "content"),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"),
            "conversations", "from", "value", roles=ROLE_NAMES),
    Mapping("instruction", ("instruction", "output"),
            fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("input", "instruction", "output"),
            fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_instruction", ("instruction", "output", "system"),
            fixed=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt_completion", ("completion", "prompt"),
            fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"),
            fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("answer", "question"),
            fixed=(("user", "question"), ("assistant", "answer"))),
    Mapping("turn_text", ("role", "text"), role_path="role", text_path="text"),
    Mapping("turn_content", ("content", "role"), role_path="role", text_path="content"),
)


def field_paths(payload: Column) -> Column:
    """Nested field paths of a JSON object: ``a``, ``a.b`` and ``a[].b``."""
    def below(key: Column) -> Column:
        def inner(at: Column, sep: str) -> Column:
            keys = F.coalesce(F.call_function("json_object_keys", F.call_function("get_json_object", payload, at)),
                              F.array().cast("array<string>"))
            return F.transform(keys, lambda c: F.concat(key, F.lit(sep), c))
        path = F.concat(F.lit("$['"), key, F.lit("']"))
        value = F.call_function("get_json_object", payload, path)
        items = F.when(F.substring(F.ltrim(value), 1, 1) == "[", F.from_json(value, "array<map<string,string>>"))
        fields = F.array_distinct(F.flatten(F.transform(F.filter(items, lambda x: x.isNotNull()), F.map_keys)))
        return F.concat(F.array(key), inner(path, "."),
                        F.coalesce(F.transform(fields, lambda c: F.concat(key, F.lit("[]."), c)), F.array().cast("array<string>")))
    return F.flatten(F.transform(F.json_object_keys(payload), below))


def fingerprint(payload: Column, mappings=MAPPINGS) -> Column:
    """64-bit hash of the sorted paths that any mapping knows; null without an object."""
    known = sorted({p for m in mappings for p in m.paths})
    paths = F.array_sort(F.array_intersect(field_paths(payload), F.array(*[F.lit(p) for p in known])))
    return F.xxhash64(F.array_join(paths, "\n"))


def _turns(payload: Column, m: Mapping) -> Column:
    def turn(role: Column, text: Column) -> Column:
        role = F.coalesce(role, F.lit(""))
        for old, new in m.roles.items():
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def at(path: str) -> Column:
        return F.get_json_object(payload, f"$['{path}']")

    if m.items:
        items = F.from_json(at(m.items), f"array<struct<`{m.role_field}`:string,`{m.text_field}`:string>>")
        return F.transform(items, lambda x: turn(x[m.role_field], x[m.text_field]))
    if m.fixed:
        # An empty optional field is no turn; the answer always is one.
        every = F.array(*[turn(F.lit(r), at(p)) for r, p in m.fixed])
        return F.filter(every, lambda x: (x["text"] != "") | (x["role"] == "assistant"))
    return F.array(turn(at(m.role_path), at(m.text_path)))


def canonical_turns(df: DataFrame, payload: str = "payload", mappings=MAPPINGS) -> DataFrame:
    """Adds ``layout`` (mapping name) and ``turns`` to each record."""
    p = F.col(payload)
    df = df.withColumn("__fp", fingerprint(p, mappings))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in mappings:
        hit = F.col("__fp") == F.xxhash64(F.lit("\n".join(sorted(m.paths))))
        layout = F.when(hit, F.lit(m.name)).otherwise(layout)
        turns = F.when(hit, _turns(p, m)).otherwise(turns)
    return df.withColumn("layout", layout).withColumn("turns", turns).drop("__fp")


def unknown_layouts(df: DataFrame, payload: str = "payload", mappings=MAPPINGS) -> DataFrame:
    """Field paths of records that no mapping covers, with their counts."""
    return (canonical_turns(df, payload, mappings).filter("layout is null")
            .groupBy(F.array_join(F.array_sort(field_paths(F.col(payload))), ", ").alias("paths"))
            .agg(F.count("*").alias("records")))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_turns(df: DataFrame, key: str, order: list[str], turns: str = "turns") -> DataFrame:
    """One row per conversation: ``key``, ``formatted`` and ``loss_spans``
    (code-point start and length of each assistant text in ``formatted``)."""
    rows = df.select(F.col(key), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)],
                     F.posexplode_outer(turns).alias("__at", "__turn"))
    sort = [*[F.col(f"__o{i}") for i in range(len(order))], F.col("__at")]
    rows = rows.select(
        key, F.struct(*sort, "__turn.role", "__turn.text").alias("__s"),
        escape(F.col("__turn.role")).alias("__r"), escape(F.col("__turn.text")).alias("__t"))
    grouped = rows.groupBy(key).agg(F.array_sort(
        F.collect_list(F.when(F.col("__r").isNotNull(), F.struct(F.struct(
            *[F.col(f"__s.{c}").isNull().alias(f"n{i}") for i, c in enumerate([f"__o{j}" for j in range(len(order))])],
            F.col("__s").alias("s")).alias("k"), "__r", "__t",
            (F.col("__s.role") == "assistant").alias("__a"))))).alias("__all"))
    piece = lambda x: F.concat(F.lit(TURN), x["__r"], F.lit(TEXT), x["__t"], F.lit(END))
    head = len(TURN) + len(TEXT)
    grouped = grouped.withColumn("formatted", F.array_join(F.transform("__all", piece), ""))

    def spans(every: Column) -> Column:
        sizes = F.transform(every, lambda x: (head + F.length(x["__r"]) + F.length(x["__t"]) + len(END)).cast("bigint"))
        placed = F.zip_with(every, running(sizes, lambda p, q: p + q), lambda x, at: F.struct(
            x["__a"].alias("a"), F.struct((at + head + F.length(x["__r"])).alias("start"),
                                          F.length(x["__t"]).cast("bigint").alias("n")).alias("span")))
        return F.transform(F.filter(placed, lambda x: x["a"]), lambda x: x["span"])

    return grouped.withColumn("loss_spans", let(F.col("__all"), spans)).drop("__all")


def read_back(formatted: Column) -> Column:
    """The turns a formatted conversation holds, unescaped."""
    parts = F.split(formatted, r"<\|turn\|>", -1)
    parts = F.slice(parts, F.lit(2), F.size(parts))
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order.

    Spans are cut from the part of the string that a block of them covers."""
    def block(part: Column) -> Column:
        low, last = F.get(part, 0)["start"], F.element_at(part, -1)
        body = F.substring(formatted, (low + 1).cast("int"), (last["start"] + last["n"] - low).cast("int"))
        return let(body, lambda b: F.array_join(F.transform(part, lambda s: unescape(
            F.substring(b, (s["start"] - low + 1).cast("int"), s["n"].cast("int")))), ""))

    return F.array_join(F.transform(blocks(spans, 128), block), "")


def digest(df: DataFrame, key: str) -> DataFrame:
    """Per conversation: counts and hashes, read from the formatted string."""
    df = df.select(key, "formatted", read_back(F.col("formatted")).alias("t"),
                   loss_text(F.col("formatted"), F.col("loss_spans")).alias("l"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return df.select(
        key, F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("l").cast("long").alias("loss_chars"), F.sha2(F.col("l"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
