import random

from pyspark.sql import functions as F

from pagewright.operators import signature

MEASURES = [m for m, _, _ in signature.TOLERANCES]
TOLERANCE = {m: t for m, t, _ in signature.TOLERANCES}


def clusters(spark, rows):
    """Rows: page, intent, titles, measures."""
    shape = "page_id bigint, page_intent string, title_shape array<string>, " + ", ".join(f"{m} double" for m in MEASURES)
    df = spark.createDataFrame([(p, i, t, *v) for p, i, t, v in rows], shape)
    names = [f.split(":")[0] for f in signature.SIGNATURE_TYPE[7:-1].split(",") if ":" in f]
    whole = df.select("page_id", F.struct(*[F.col(n) if n in df.columns else F.lit(None).alias(n) for n in names]).cast(
        signature.SIGNATURE_TYPE).alias("structure"))
    return {r.page_id: (r.cluster, r.medoid, r.pages) for r in signature.template_clusters(whole).collect()}


def plain(rows):
    """Cuts every group at gaps, measure by measure, until nothing changes."""
    groups = {}
    for p, i, t, v in rows:
        groups.setdefault((i, tuple(t) if t is not None else None, tuple(x is None for x in v)), []).append((p, v))
    todo, done = list(groups.values()), []
    while todo:
        group = todo.pop()
        for k, m in enumerate(MEASURES):
            own = sorted(group, key=lambda x: (x[1][k] is None, x[1][k] or 0))
            cut = next((j for j in range(1, len(own)) if own[j][1][k] is not None and own[j][1][k] - own[j - 1][1][k] > TOLERANCE[m]), None)
            if cut:
                todo += [own[:cut], own[cut:]]
                break
        else:
            done.append(group)
    out = {}
    for group in done:
        def far(x):
            return sum(signature._WEIGHTS[TOLERANCE[m]] * abs(len(group) * round(x[1][k] * 10**6) - sum(round(y[1][k] * 10**6) for y in group))
                       for k, m in enumerate(MEASURES) if x[1][k] is not None)
        medoid = min(group, key=lambda x: (far(x), x[0]))[0]
        out.update({p: (min(x[0] for x in group), medoid, len(group)) for p, _ in group})
    return out


def test_chains_stay_together_and_gaps_part(spark):
    chain = [(i, "article", ["h1"], (0.3 * i, 1.0, 1.0, 0.0)) for i in range(4)]
    apart = [(10 + i, "article", ["h1"], (1.3 + i / 100, 1.0, 1.0, 0.0)) for i in range(3)]
    other = [(20, "article", ["h1", "h2"], (0.1, 1.0, 1.0, 0.0)), (21, "article", ["h1"], (0.1, None, 1.0, 0.0)), (22, None, None, (None,) * 4)]
    got = clusters(spark, chain + apart + other)
    assert {got[i][0] for i in range(4)} == {0} and got[0][1:] == (1, 4)
    assert {got[i] for i in (10, 11, 12)} == {(10, 11, 3)}
    assert [got[i] for i in (20, 21, 22)] == [(20, 20, 1), (21, 21, 1), (22, 22, 1)]
    assert clusters(spark, []) == {}


def test_equal_to_plain_cuts(spark):
    rng = random.Random(8)
    rows = []
    for p in range(400):
        centre = rng.choice([(0.0, 0.0, 0.0, 0.0), (0.9, 0.1, 0.5, 0.0), (0.5, 0.95, 0.0, 0.9), (0.45, 0.0, 1.0, 0.4)])
        values = tuple(None if rng.random() < 0.02 else round(min(1.0, max(0.0, c + rng.gauss(0, 0.08))), 3) for c in centre)
        rows.append((p * 7 % 401, rng.choice(["article", "list"]), rng.choice([["h1"], []]), values))
    got = clusters(spark, rows)
    assert got == plain(rows) and len({c for c, _, _ in got.values()}) > 8
