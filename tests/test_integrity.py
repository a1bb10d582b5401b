import random

import pytest
from pyspark.sql import functions as F

from tablecloak.operators import integrity, stats

EDGES = [("attachment", "message"), ("message", "user"), ("order", "user")]


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "table string")


def edges(spark, pairs=EDGES):
    return spark.createDataFrame(pairs, "child string, parent string")


@pytest.mark.parametrize("seed,want", [
    (["message"], {"attachment", "message"}), (["user"], {"attachment", "message", "order", "user"}),
    (["attachment"], {"attachment"}), ([], set()), (["unknown", "unknown"], {"unknown"})])
def test_closure(spark, seed, want):
    got = [r["table"] for r in integrity.fk_closure(edges(spark), names(spark, seed)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_closure_with_cycles_and_without_broadcast(spark, monkeypatch):
    pairs = EDGES + [("user", "attachment"), ("user", "user"), ("x", "y")]
    for limit in (integrity.BROADCAST_ROWS, 0):
        monkeypatch.setattr(integrity, "BROADCAST_ROWS", limit)
        got = {r["table"] for r in integrity.fk_closure(edges(spark, pairs), names(spark, ["user"])).collect()}
        assert got == {"attachment", "message", "order", "user"}


@pytest.mark.parametrize("seed", range(4))
def test_closure_is_the_least_fixpoint(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"t{rng.randrange(30)}", f"t{rng.randrange(30)}") for _ in range(25)]
    start = {f"t{rng.randrange(30)}" for _ in range(2)}
    want, todo = set(start), list(start)
    while todo:
        parent = todo.pop()
        for child, p in pairs:
            if p == parent and child not in want:
                want.add(child)
                todo.append(child)
    got = [r["table"] for r in integrity.fk_closure(edges(spark, pairs), names(spark, sorted(start))).collect()]
    assert sorted(got) == sorted(want)


def test_closure_stays_inside_a_database(spark, rows):
    e = spark.createDataFrame([("a", "child", "root"), ("b", "child", "root")],
                              "database string, child string, parent string")
    s = spark.createDataFrame([("a", "root")], "database string, table string")
    assert rows(integrity.fk_closure(e, s), "database", "table") == [("a", "child"), ("a", "root")]


def test_dangling_and_cascade(spark, rows):
    assert rows(integrity.fk_dangling(edges(spark), names(spark, ["user"]))) == [("message", "user"), ("order", "user")]
    assert rows(integrity.cascade_exclusions(edges(spark), names(spark, ["message"]))) == [("attachment",)]


def test_database_setting_wins_even_when_false():
    assert integrity.exclude_dependents(False, True) is False
    assert integrity.exclude_dependents(None, True) is True
    assert integrity.exclude_dependents(None, None) is False


def test_orphans_keep_null_keys(spark, rows):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id int, ref int")
    parent = spark.createDataFrame([(10,)], "pk int")
    assert rows(integrity.orphan_rows(child, parent, [("ref", "pk")]), "id") == [(2,)]


def shop(spark):
    return {
        "users": spark.createDataFrame([(1, "old"), (2, "new"), (3, None)], "id int, state string"),
        "orders": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "oid int, user_id int"),
        "items": spark.createDataFrame([(100, 10, 7), (101, 11, 7), (102, 12, 8)], "iid int, order_id int, product int"),
        "products": spark.createDataFrame([(7,), (8,)], "pid int")}


FK = [("orders", "user_id", "users", "id"), ("items", "order_id", "orders", "oid"),
      ("items", "product", "products", "pid")]


def test_prune_cascade(spark, rows):
    out = integrity.prune_cascade(shop(spark), FK, "users", F.col("state") == "old")
    assert rows(out["users"], "id") == [(2,), (3,)]
    assert rows(out["orders"], "oid") == [(11,), (12,)]
    assert rows(out["items"], "iid") == [(101,), (102,)]
    assert out["items"].columns == ["iid", "order_id", "product"]
    both = integrity.prune_cascade(shop(spark), FK, "products", F.col("pid") == 7)
    assert rows(both["items"], "iid") == [(102,)] and rows(both["orders"], "oid") == [(10,), (11,), (12,)]


@pytest.mark.parametrize("seed", range(3))
def test_prune_over_a_cycle_of_tables_is_the_least_fixpoint(spark, seed):
    """Three tables in a ring with a chord, one that references itself as well, one above and two below."""
    rng = random.Random(seed)
    refs = [("team", "lead", "user", "id"), ("user", "team", "team", "id"), ("user", "boss", "user", "id"),
            ("doc", "owner", "user", "id"), ("team", "charter", "doc", "no"), ("user", "org", "org", "id"),
            ("note", "doc", "doc", "no"), ("note", "team", "team", "id"), ("tag", "note", "note", "id")]
    columns = {"org": ["id"], "team": ["id", "lead", "charter"], "user": ["id", "team", "boss", "org"],
               "doc": ["no", "owner"], "note": ["id", "doc", "team"], "tag": ["id", "note"], "free": ["id"]}
    pick = lambda: rng.choice([None, None, *range(25)])
    data = {t: [{c: (i if c in ("id", "no") else pick()) for c in cols} for i in range(25)] for t, cols in columns.items()}
    data["user"].append({"id": None, "team": 3, "boss": None, "org": 4})
    gone = {t: set() for t in data}
    gone["org"] = {i for i, r in enumerate(data["org"]) if r["id"] % 9 == seed}
    while True:
        more = [(c, i) for c, col, p, k in refs for i, r in enumerate(data[c]) if i not in gone[c] and r[col] is not None
                and any(data[p][j][k] == r[col] for j in gone[p])]
        if not more:
            break
        for c, i in more:
            gone[c].add(i)
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows_], ", ".join(f"{c} int" for c in columns[t]))
              for t, rows_ in data.items()}
    out = integrity.prune_cascade(frames, refs, "org", F.col("id") % 9 == seed)
    for t, rows_ in data.items():
        want = sorted((tuple(r.values()) for i, r in enumerate(rows_) if i not in gone[t]), key=repr)
        assert sorted(map(tuple, out[t].collect()), key=repr) == want, t
    assert any(gone["team"]) and len(gone["tag"]) < 25


def test_prune_starts_inside_a_cycle(spark, rows):
    users = spark.createDataFrame([(1, 10), (2, 20), (3, 10), (4, None)], "id int, team int")
    teams = spark.createDataFrame([(10, 2), (20, 3), (30, 4)], "id int, lead int")
    refs = [("users", "team", "teams", "id"), ("teams", "lead", "users", "id")]
    out = integrity.prune_cascade({"users": users, "teams": teams}, refs, "users", F.col("id") == 2)
    assert rows(out["users"]) == [(4, None)] and rows(out["teams"]) == [(30, 4)]


def test_groups_of_tables_come_parents_first():
    refs = {"b": [("x", "a", "k")], "c": [("x", "b", "k"), ("y", "d", "k")], "d": [("x", "c", "k")], "e": [("x", "d", "k"), ("y", "e", "k")]}
    assert integrity._components(set("abcde"), refs) == [["a"], ["b"], ["c", "d"], ["e"]]


def test_truncate_and_recent(spark):
    data = shop(spark)
    e = edges(spark, [(c, p) for c, _, p, _ in FK])
    out = integrity.truncate_tables(data, ["users"], e)
    assert {n: df.count() for n, df in out.items()} == {"users": 0, "orders": 0, "items": 0, "products": 2}
    only = integrity.truncate_tables(data, ["users"])
    assert only["orders"].count() == 3
    ts = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-01 00:00:00'), (timestamp_ntz'2024-01-08 00:00:00') AS t(ts)")
    assert integrity.keep_recent(ts, "ts", 7, "2024-01-09 00:00:00").count() == 1


def test_stats(spark, rows):
    raw = spark.createDataFrame([("public.a", "100", str(2 * 1024 * 1024)), ("publicXa", "50", str(1024 * 1024)),
                                 ("public.ab", "x", None), ("", "1", "1")],
                                "table string, rows string, size_bytes string")
    s = stats.clean_stats(raw)
    assert tuple(stats.stats_totals(s).first()) == (3, 150, 3.0)
    assert tuple(stats.stats_totals(s.limit(0)).first()) == (0, 0, 0.0)
    ex = names(spark, ["public.a"])
    assert rows(stats.tag_excluded(s, ex), "table", "excluded") == [
        ("public.a", True), ("public.ab", False), ("publicXa", False)]
    assert stats.exclusion_savings(s, ex).first()[0] == 2.0


def test_prune_follows_self_references(spark, rows):
    staff = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 4), (6, 6), (None, 3)], "id int, boss int")
    badge = spark.createDataFrame([(10, 3), (11, 5), (12, None)], "b int, staff int")
    edges = [("staff", "boss", "staff", "id"), ("badge", "staff", "staff", "id")]
    out = integrity.prune_cascade({"staff": staff, "badge": badge}, edges, "staff", F.col("id") == 1)
    assert rows(out["staff"]) == [(4, None), (5, 4), (6, 6)] and rows(out["badge"]) == [(11, 5), (12, None)]


def test_prune_ends_on_a_cycle_with_a_null_key(spark, rows):
    parts = spark.createDataFrame([(1, None, 2, None), (2, None, 1, None), (3, "c", None, "c"), (4, None, None, "c"),
                                   (5, "e", 1, None)], "id int, code string, after int, like string")
    edges = [("parts", "after", "parts", "id"), ("parts", "like", "parts", "code")]
    out = integrity.prune_cascade({"parts": parts}, edges, "parts", F.col("id") == 1)
    assert rows(out["parts"], "id") == [(3,), (4,)]
