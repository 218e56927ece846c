"""Population search steps (ABC, ACO, FPA, PSO).

Every step is population table in → population table out.  A generation
proposes all its candidates first, scores them in ONE call of a scorer
(``DataFrame(member, mask) -> + (obj, f1, k)``), then accepts.  The
synchronous form is exact for FPA and ACO (their reference loops do not
read in-generation updates); for ABC and PSO it is the synchronous variant
(partners/gbest from the previous generation state).
"""
