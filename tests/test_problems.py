"""The general problems on small tables: nulls, empties, repeats, ties, hot keys, clashing columns, against plain code."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from caseframe.functions import values as V
from caseframe.operators import hierarchy, orphans, running, skew, weighted, wide

# (text, value) by type; None: states no value.
NOTATIONS = {
    "whole": [("42", 42), (" 42\x00", 42), ("+42", 42), ("-7", -7), ("2,048", 2048), ("8'192", 8192), ("1 024", 1024), ("1 024", 1024), ("1024.0", 1024), ("0x1F", 31), ("0x0000001f", 31), ("12 pages", 12), ("12pp.", 12), ("512 B", 512), ("3 KiB", 3072),
              ("n/a", None), ("", None), ("many", None), ("12.5", None), ("12,34", None), ("0x", None), ("99999999999999999999", None), ("12 apples", None), ("1 2", None), (None, None)],
    "real": [("1.5", 1.5), ("1,5", 1.5), ("+1.5", 1.5), ("4.5e+01", 45.0), ("50 %", 50.0), ("50%", 50.0), ("96dpi", 96.0), ("1,234.5", 1234.5), ("1.234,5", 1234.5), ("3", 3.0), ("01:30", 90.0), ("high", None), ("#DIV/0!", None), (".", None), (None, None)],
    "truth": [("Yes", True), (" yes", True), ("set", True), ("1", True), ("unset", False), ("OFF", False), ("N", False), ("maybe", None), ("2", None), ("", None), (None, None)],
    "text": [("  a b ", "a b"), ("unknown", None), ("—", None), ("<unset>", None), ("None", None), ("nonesuch", "nonesuch"), (None, None)],
    "time": [("2008-10-27 13:36:32", "2008-10-27 13:36:32"), ("2005-04-14T07:16:55Z", "2005-04-14 07:16:55"), ("2011-01-06T11:05:29+02:00", "2011-01-06 09:05:29"), ("2007-07-21T20:49:12+1000", "2007-07-21 10:49:12"), ("2008:05:21 19:35:33", "2008-05-21 19:35:33"),
             (" 2004-08-26 ", "2004-08-26 00:00:00"), ("D:20080603170256", "2008-06-03 17:02:56"), ("20110214", "2011-02-14 00:00:00"), ("30.08.2008 13:17", "2008-08-30 13:17:00"), ("24 Nov 2009 17:04", "2009-11-24 17:04:00"), ("25/May/2006:07:26:00 +0000", "2006-05-25 07:26:00"),
             ("Fri Sep  2 00:49:16 2005", "2005-09-02 00:49:16"), ("1138798072", "2006-02-01 12:47:52"), ("1131496986000", "2005-11-09 00:43:06"), ("2008-14-32", None), ("2009-02-30", None), ("0000-00-00", None), ("00/00/0000", None), ("last Tuesday", None), ("", None), ("42", None), (None, None)],
}


@pytest.mark.parametrize("kind", NOTATIONS)
def test_notations(kind, spark):
    f = {"whole": V.whole_value, "real": V.real_value, "truth": V.truth_value, "text": V.text_value, "time": V.time_value}[kind]
    cases = NOTATIONS[kind]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r[0]: r[1] for r in rows.select("i", (f(F.col("t")).cast("string") if kind == "time" else f(F.col("t")))).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(cases)] == cases


def test_property_names(spark):
    names = ["page count", "Page-Count:", "PAGE_COUNT", "pageCount", "[page count]", "page.count", "page count", " page_count\t", "exif:page-count", "meta/page count", "pdf.page_count", "PAGE  COUNT"]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    assert {r[0] for r in rows.select(V.property_name(F.col("p"))).collect()} == {"page_count"}
    other = spark.createDataFrame([("page count estimate",), ("xpage count",), ("",)], "p string")
    assert "page_count" not in {r[0] for r in other.select(V.property_name(F.col("p"))).collect()}


COLUMNS = [("a", "string"), ("b", "bigint"), ("c", "double"), ("d", "timestamp"), ("e", "boolean")]


def test_wide(spark):
    facts = [("x", "B", "1"), ("x", "b", "2"), ("x", "b:", "2"), ("x", "b", "2"), ("x", "b", "n/a"), ("x", "zzz", "9"), ("y", "A", " t "), ("y", "e", "off"), ("y", "c", "1,5"), ("y", "d", "20110214"), ("z", "b", "none"), (None, "b", "3"), ("", "b", "4"), ("w", None, "1"), ("w", "a", None), ("t", "b", "5"), ("t", "b", "4")]
    df = spark.createDataFrame([(*f, "k", 1) for f in facts], "entity string, property string, value string, k string, n int")
    got = {r[0]: tuple(r)[1:] for r in wide.wide(df, COLUMNS).collect()}
    empty = (None,) * 5
    assert got == {"x": (None, 2, None, None, None), "y": ("t", None, 1.5, dt.datetime(2011, 2, 14), False), "z": empty, "w": empty, "": (None, 4, None, None, None), "t": (None, 4, None, None, None)}
    cells = wide.filled(wide.wide(df, COLUMNS), "entity", COLUMNS)
    assert {tuple(r) for r in cells.collect()} == {("x", "b"), ("y", "a"), ("y", "c"), ("y", "d"), ("y", "e"), ("", "b"), ("t", "b")}


def test_wide_edges(spark):
    none = spark.createDataFrame([], "entity long, property string, value string")
    out = wide.wide(none, COLUMNS)
    assert out.columns == ["entity", "a", "b", "c", "d", "e"] and out.count() == 0
    assert wide.wide(spark.createDataFrame([(1, "b", "1")], "entity long, property string, value string"), []).collect() == [(1,)]
    # one entity with most rows, over several batches
    many = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("entity"), F.lit("b").alias("property"), F.col("id").cast("string").alias("value"))
    got = wide.wide(many, COLUMNS)
    assert got.count() == got.select("entity").distinct().count() == many.select("entity").distinct().count()


def test_weighted_keys(spark):
    random.seed(1)
    rows = [(random.choice([1, 1, 1, 2, 3, None]), random.choice([None, 5, 6, 7, 8]), random.randrange(100)) for _ in range(500)] + [(9, None, 3)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "k long, v long, pos long, weight int")
    got = {r["k"]: r for r in weighted.per_key(weighted.compress(df, "k", "v", "pos"), "k", "v").collect()}
    by = defaultdict(list)
    for k, v, p in rows:
        if k is not None:
            by[k].append((v, p))
    assert got.keys() == by.keys()
    for k, vs in by.items():
        c = Counter(v for v, _ in vs if v is not None)
        mode = min(c, key=lambda v: (-c[v], v)) if c else None
        assert tuple(got[k])[1:] == (len(vs), len(c), min(p for _, p in vs), max(p for _, p in vs), mode, c[mode] if c else None)
    percent = {r["k"]: r for r in weighted.weighted_percentiles(weighted.compress(df, "k", "pos"), "k", "pos", [0.5, 0.9]).collect()}
    for k, vs in by.items():
        ps = sorted(p for _, p in vs)
        for s in (0.5, 0.9):
            assert percent[k][f"p{round(s * 100)}"] == next(p for i, p in enumerate(ps) if i + 1 >= s * len(ps))
    heavy = {r[0] for r in weighted.heavy_keys(df, "k", "v", 0.01).collect()}
    assert heavy == {k for k, vs in by.items() if len(vs) >= 0.01 * len(rows)}
    assert weighted.heavy_keys(df.limit(0), "k", "v", 0.01).count() == 0


def test_hot_keys(spark):
    df = spark.createDataFrame([(1,)] * 90 + [(None,)] * 50 + [(i,) for i in range(2, 60)], "k long")
    hot = skew.hot_keys(df, "k", least=10)
    assert hot == {1: 9} and skew.hot_keys(df.limit(0), "k") == skew.hot_keys(df, "k") == skew.hot_keys(df, "k", least=200, rows=198) == {}
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "k long, name string")
    facts = df.withColumn("n", F.monotonically_increasing_id())
    joined = skew.lookup_join(facts, dim, "k", F.col("n"), "left", hot)
    assert joined.count() == df.count() and joined.filter("name = 'a'").count() == 90 and joined.filter("name = 'b'").count() == 1


def test_many_hot_keys(spark):
    """Every key above what a task may hold is spread, also one of a fiftieth of the rows, each over as many salts as it needs."""
    df = spark.range(10_000).select(F.when(F.col("id") < 4_000, 1).otherwise(2 + F.col("id") % 30).alias("k"), F.col("id").alias("n"))
    hot = skew.hot_keys(df, "k", least=150)
    assert len(hot) == 31 and hot[1] == 27 and hot[2] == 2
    spread = skew.salted(df, "k", hot, F.col("n")).groupBy("k", "_salt").count()
    assert spread.agg(F.max("count")).first()[0] < 230
    dim = spark.range(1, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    joined = skew.lookup_join(df, dim, "k", F.col("n"), "inner", least=150)
    assert joined.count() == 10_000 and joined.filter("twice != 2 * k").count() == 0


@pytest.mark.parametrize("name", ["p2_offset_percentiles", "p3_hierarchy", "p3_descendants", "p6_orphan_references"])
def test_salted_queries(name, spark, data, monkeypatch):
    """The same rows when almost every key counts as hot."""
    from caseframe.plans import problems

    monkeypatch.setattr(skew, "TASK_ROWS", 20)
    got = sorted(map(tuple, problems.QUERIES[name](spark, data).collect()))
    monkeypatch.undo()
    assert got == sorted(map(tuple, problems.QUERIES[name](spark, data).collect()))


@pytest.mark.parametrize("name", ["p6_found", "p6_orphans", "p6_report"])
def test_salted_struct_keys(name, spark, data, monkeypatch):
    """The state's keys are structs of table and id; hot ones are salted like any others."""
    from caseframe.plans import problems

    want = sorted(map(tuple, problems.QUERIES[name](spark, data).collect()))
    monkeypatch.setattr(skew, "TASK_ROWS", 20)
    assert want and sorted(map(tuple, problems.QUERIES[name](spark, data).collect())) == want


def test_salted_struct_with_null(spark):
    facts = spark.createDataFrame([("a", None, i) for i in range(9)] + [("a", 1, i) for i in range(9)] + [("b", 1, 0)], "t string, k long, i int").select(F.struct("t", "k").alias("key"), "i")
    dim = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "t string, k long, v string").select(F.struct("t", "k").alias("key"), "v")
    got = skew.lookup_join(facts, dim, "key", F.col("i"), least=4).collect()
    assert Counter((r["key"]["t"], r["key"]["k"], r["v"]) for r in got) == {("a", None, None): 9, ("a", 1, "x"): 9, ("b", 1, "y"): 1}


def test_deep_chain(spark):
    """A chain of 100,000 beside a circle with a tail: three numbers a node, whatever the depth."""
    n = 100_000
    chain = spark.range(1, n + 1).select("id", (F.col("id") - 1).alias("parent"), F.lit("x").alias("name"))
    circle = spark.createDataFrame([(n + 1, n + 2, "a"), (n + 2, n + 1, "b"), (n + 3, n + 1, "c")], "id long, parent long, name string")
    h = hierarchy.Hierarchy(chain.unionByName(circle))
    assert {r[0] for r in h.circular.collect()} == {n + 1, n + 2, n + 3}
    assert h.roots.agg(F.count("*"), F.max("depth"), F.sum("depth"), F.max("root")).first() == (n, n - 1, n * (n - 1) // 2, 1)
    assert h.roots.filter(F.col("depth") != F.col("id") - 1).count() == 0


def _ends(nodes):
    out = {}
    for i in nodes:
        seen, at, path = set(), i, []
        while True:
            if at in seen:
                break
            seen.add(at)
            path.append(at)
            p = nodes[at][0]
            if p in (None, 0) or p not in nodes:
                out[i] = path[::-1]
                break
            at = p
    return out


def test_hierarchy(spark):
    random.seed(4)
    nodes = {i: (random.choice([None, 0, 999, *range(1, i)]) if i > 1 else 0, random.choice(["a", "b/c", "", None])) for i in range(1, 120)}
    nodes |= {i: (i - 1, f"n{i}") for i in range(200, 300)} | {200: (0, "top")}
    nodes |= {400: (401, "x"), 401: (402, "x"), 402: (400, "x"), 403: (400, "below"), 404: (404, "self"), 405: (403, None)}
    rows = [(i, n, p, "q", 1) for i, (p, n) in nodes.items()]
    df = spark.createDataFrame(rows + rows[:20] + [(None, "no id", 1, "q", 1)], "id int, name string, parent int, path string, ptr int")
    resolved, circular = hierarchy.resolve(df)
    want = _ends(nodes)
    assert {r[0] for r in circular.collect()} == {400, 401, 402, 403, 404, 405} == set(nodes) - set(want)
    got = {r["id"]: r for r in resolved.collect()}
    assert got.keys() == want.keys()
    for i, path in want.items():
        assert (got[i]["root"], got[i]["depth"], list(got[i]["lineage"])) == (path[0], len(path) - 1, path)
        assert got[i]["path"] == "".join("/" + (nodes[x][1] or "") for x in path)
    pairs = {tuple(r) for r in hierarchy.descendants(resolved).collect()}
    assert pairs == {(a, i, len(p) - 1 - k) for i, p in want.items() for k, a in enumerate(p[:-1])}


def test_hierarchy_edges(spark):
    for rows in ([], [(1, None, 1)], [(1, "r", None)]):
        resolved, circular = hierarchy.resolve(spark.createDataFrame(rows, "id int, name string, parent int"))
        assert resolved.count() + circular.count() == len(rows)


def test_orphans(spark):
    t = lambda day: dt.datetime(2011, 1, 1) + dt.timedelta(days=day)
    random.seed(5)
    refs = [(random.choice([None, 1, 2, 3, 4, 5]), t(random.randrange(120))) for _ in range(300)]
    targets = [(1, t(40)), (1, t(70)), (2, t(200)), (3, t(-5)), (None, t(0)), (5, t(60)), (5, t(60))]
    r = spark.createDataFrame([(*x, 0, "p") for x in refs], "ref long, loaded timestamp, refs int, period string")
    g = spark.createDataFrame([(*x, 1) for x in targets], "id int, loaded timestamp, exist int")
    month = lambda c: F.date_format(c, "yyyy-MM")
    got = {(x["ref_id"], x["period"]): (x["refs"], x["state"]) for x in orphans.orphans([orphans.Reference("r", r, "ref", g, "g", "id")], month).collect()}
    born = {}
    for k, at in targets:
        if k is not None:
            born[k] = min(born.get(k, at), at)
    by = defaultdict(list)
    for k, at in refs:
        if k is not None:
            by[k, at.strftime("%Y-%m")].append(at)
    want = {key: (len(v), "later" if key[0] in born else "absent") for key, v in by.items() if key[0] not in born or min(v) < born[key[0]]}
    assert got == want
    timeless = orphans.orphans([orphans.Reference("r", r, "ref", g, "g", "id", since=False)], month)
    assert {x["ref_id"] for x in timeless.collect()} == {4}
    assert orphans.orphans([orphans.Reference("r", r.limit(0), "ref", g.limit(0), "g", "id")], month).count() == 0


def test_orphan_references(spark):
    """Only rows before the birth of their key count, each distinct row once; the keys and periods are those of orphans()."""
    t = lambda day: dt.datetime(2011, 1, 1) + dt.timedelta(days=day)
    random.seed(7)
    refs = [(random.choice([None, 1, 2, 3, 4, 5]), None if i % 50 == 0 else t(random.randrange(120)), i) for i in range(300)]
    refs += refs[:80]
    targets = [(1, t(40)), (1, t(70)), (2, t(200)), (3, t(-5)), (None, t(0)), (5, t(60)), (5, t(60))]
    r = spark.createDataFrame([(*x, "p", 0) for x in refs], "ref long, loaded timestamp, refs int, period string, born int")
    g = spark.createDataFrame(targets, "id int, loaded timestamp")
    month = lambda c: F.date_format(c, "yyyy-MM")
    ref = orphans.Reference("r", r, "ref", g, "g", "id")
    born = {k: min(at for j, at in targets if j == k) for k, _ in targets if k is not None}
    want = Counter((k, at and at.strftime("%Y-%m"), "later" if k in born else "absent") for k, at, _ in set(refs) if k is not None and (k not in born or at is None or at < born[k]))
    got = orphans.orphan_references([ref], month).collect()
    assert {(x["ref_id"], x["period"], x["state"]): x["orphan_refs"] for x in got} == dict(want) and len(got) == len(want)
    keys = orphans.orphans([ref], month).collect()
    assert {(x["ref_id"], x["period"], x["state"]) for x in keys} == set(want)
    assert sum(x["refs"] for x in keys) > sum(want.values())
    timeless = orphans.orphan_references([orphans.Reference("r", r, "ref", g, "g", "id", since=False)], month)
    assert {x["ref_id"] for x in timeless.collect()} == {4}
    assert orphans.orphan_references([orphans.Reference("r", r.limit(0), "ref", g.limit(0), "g", "id")], month).count() == 0


def test_maintained_counts(spark, tmp_path):
    """Batches of arrivals and deletions, late rows among them, give the state and report of the rows that are left."""
    t = lambda day: dt.datetime(2011, 1, 1) + dt.timedelta(days=day)
    random.seed(9)
    month = lambda c: F.date_format(c, "yyyy-MM")
    schema = "ref long, loaded timestamp", "id long, loaded timestamp"
    empty = [spark.createDataFrame([], s) for s in schema]
    ref = orphans.Reference("r", empty[0], "ref", empty[1], "g", "id")
    kept = orphans.Maintained(spark, str(tmp_path / "state"))
    live: tuple[list, list] = ([], [])
    for batch in range(5):
        new = [[(random.choice([None, *range(8)]), random.choice([None, *map(t, range(0, 120, 7))])) for _ in range(n)] for n in (60, 5)]
        gone = [random.sample(x, len(x) // 3) for x in live]
        for x, add, drop in zip(live, new, gone):
            x += add
            for row in drop:
                x.remove(row)
        up, down = ([spark.createDataFrame(rows, s) for rows, s in zip(side, schema)] for side in (new, gone))
        changes = orphans.deltas(ref, *up).unionByName(orphans.deltas(ref, *down, sign=-1))
        kept.apply(changes, batch)
        kept.apply(changes, batch)  # a batch that comes again
    whole = orphans.Reference("r", spark.createDataFrame(live[0], schema[0]), "ref", spark.createDataFrame(live[1], schema[1]), "g", "id")
    once = orphans.merged(None, orphans.deltas(whole))
    assert sorted(map(str, kept.state().collect())) == sorted(map(str, once.collect()))
    want = orphans.orphans([whole], month).drop("target")
    assert sorted(map(str, orphans.report(kept.state(), month).collect())) == sorted(map(str, want.collect())) and want.count()
    assert [p.name for p in (tmp_path / "state").iterdir()] == ["v4"]
    # A deleted target row makes its references orphans, a late one ends that.
    one = orphans.Reference("r", spark.createDataFrame([(1, t(9))], schema[0]), "ref", spark.createDataFrame([(1, t(3))], schema[1]), "g", "id")
    state = orphans.merged(None, orphans.deltas(one))
    assert orphans.report(state, month).count() == 0
    state = orphans.merged(state, orphans.deltas(one, targets=one.target, sign=-1))
    assert [r["state"] for r in orphans.report(state, month).collect()] == ["absent"]
    state = orphans.merged(state, orphans.deltas(one, targets=spark.createDataFrame([(1, t(20))], schema[1])))
    assert [r["state"] for r in orphans.report(state, month).collect()] == ["later"]


@pytest.mark.parametrize("ranges", [1, 3, 256])
def test_running(spark, ranges):
    random.seed(6)
    rows = [(random.choice([1, 1, 1, 2, None]), i * 3 % 997, random.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    got = running.running(df, "k", "o", {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v")), "b": ("before", F.col("v"))}, ranges)
    want = []
    for k in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for i, r in enumerate(mine):
            vs = [x[2] for x in mine[: i + 1]]
            want.append((*r, i + 1, sum(vs), max(vs), max(vs[:-1], default=None)))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_running_outlier(spark):
    """One far value leaves the others in many ranges; a key of most rows and the table without a key are cut alike."""
    rows = [(1 if i % 10 else 2, i, 1) for i in range(5000)] + [(1, 10**12, 1), (2, None, 1)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    cuts = running._cuts(df.withColumn("_o", F.col("o").cast("double")), None)
    assert len(cuts) >= running.LEAST_RANGES - 1 and cuts[len(cuts) // 2] < 5000
    got = {(r["k"], r["o"]): r["n"] for r in running.running(df, "k", "o", {"n": ("count", F.lit(1))}).collect()}
    assert got[(1, 10**12)] == 4501 and got[(2, None)] == 1 and got[(2, 0)] == 2 and len(got) == len(rows)
    whole = running.running(df, None, "o", {"n": ("count", F.lit(1))}).agg(F.max("n"), F.count_distinct("n")).first()
    assert tuple(whole) == (5002, 5002)
