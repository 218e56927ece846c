import re

import corpus_pipeline as P
from swarmsift.llm import queries

from .conftest import DOCS
from .test_decontaminate import brute as leaks
from .test_minhash_forest import brute as near
from .test_packing import check as packed
from .test_secret_scan import brute as secrets

COLUMNS = DOCS.replace(" long", " bigint")


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, whole tables."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in P.STAGES:
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        if name == "toxicity":
            got = {r.doc_id for r in queries.op5_toxicity(spark, sf).collect() if r.predicted == 0}
            assert set(new) == got
        elif name == "near_duplicates":
            _, comp = near({d: r.text for d, r in old.items()}, 5)
            assert set(new) == {d for d in old if comp[d] == d} and len(new) < len(old)
        elif name == "decontamination":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
            assert set(new) == set(old) - {d for d, _ in leaks({d: r.text for d, r in old.items()}, items)}
        elif name == "secrets":
            assert set(new) == set(old)
            changed = 0
            for d, r in new.items():
                t = old[d].text or ""
                spans = secrets(t)
                assert not spans or "[REDACTED]" in r.text
                for a, _, b in spans:
                    assert t[a:b] not in r.text or re.fullmatch(r"\W*", t[a:b])
                changed += r.text != t
                assert r.n_chars == (len(r.text) if r.text != t else old[d].n_chars)
            assert 0 < changed < len(new) / 2
        else:
            packed(after.collect(), {d: r.text for d, r in old.items()})
            break
        assert after.dtypes == docs.dtypes
        assert all(new[d] == old[d] for d in new) or name == "secrets"
        before = after


def test_run_and_edges(spark, write_tables):
    rows = [(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None), (2, "a b c d e f g h", "en", "s", 15),
            (3, "a b c d e f g h", None, None, None), (4, "token=abcdefgh", "en", None, None)]
    sf = write_tables(documents=(rows, DOCS), labels=([], "doc_id long, quality int, toxic int"),
                      benchmark=([(1, "no such passage here at all")], "item_id long, text string"))
    out = P.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {None, 1, 2, 4}


def test_empty(spark, write_tables):
    sf = write_tables(documents=([], DOCS), labels=([], "doc_id long, quality int, toxic int"),
                      benchmark=([], "item_id long, text string"))
    assert P.run(spark, sf).count() == 0


def test_rows_that_share_an_id(spark):
    """The same text once; different texts of one id both stay."""
    rows = [(1, "one two three four five six", "en", "s", 1), (1, "one two three four five six", "en", "s", 1),
            (1, "another text that differs in every word", "en", "s", 1), (2, "one two three four five six", "en", "s", 1),
            (None, "x y", "en", "s", 1), (None, "x y z", "en", "s", 1)]
    got = sorted((r.doc_id or 0, r.text) for r in P.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect())
    assert got == [(0, "x y"), (0, "x y z"), (1, "another text that differs in every word"), (1, "one two three four five six")]
