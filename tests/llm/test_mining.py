"""Fill-in-middle, phrases and mixing against plain versions, and their odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tablecloak.llm import fill_middle, mixing, near_dup, phrases, queries

SF = "/root/testdata/sf0.01"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", " ", "\n\t ", "a", " a", "a ", "é  ß\n", "<P> stays", "x<M>", "<", "<P", "a < b <S", "𝄞 𝄞𝄞 \x85 z",
             "word " * 400, "  two  gaps  ", "no-gap" * 50]


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_phrases", "op13_source_mix"])
def test_sql_agrees(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.sql(queries.ORACLES[name]).df()[list(got.columns)]
    order = list(got.columns[:3])
    a, b = (x.sort_values(order).astype(object).where(x.notna(), None).values.tolist() for x in (
        got.sort_values(order), want.sort_values(order)))
    assert len(a) > 100 and sorted(map(repr, a)) == sorted(map(repr, b)) or a == b


def plain_fim(i, text, seed=42, rate=50):
    text = text or ""
    tokens = TOKEN.findall(text)
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_of_odd_rows(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD_TEXTS * 12)] + [(None, "no id here", "x"), (7, "again", ""), (7, "again", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, output string")
    done = fill_middle.restore(fill_middle.transform(docs, rate=90)).collect()
    want = Counter((i, *plain_fim(i, t, rate=90), t or "") for i, t, _ in rows)
    assert Counter(map(tuple, done)) == want
    assert {r.form for r in done} == {"plain", "psm", "spm"}
    assert fill_middle.digests(docs.limit(0)).count() == 0


def test_fill_middle_moves_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 7)
    pick = random.Random(3)
    texts = ["".join(pick.choice("ab \né<") for _ in range(pick.randint(0, 60))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    ends, n = fill_middle.token_ends(data, offsets)
    assert n.tolist() == [len(TOKEN.findall(t)) for t in texts]
    cuts = np.array([sorted((a + pick.randint(0, b - a), a + pick.randint(0, b - a))) for a, b in zip(offsets, offsets[1:])])
    order = np.array([pick.choice((-1, 0, 1)) for _ in texts])
    marks = fill_middle.checked_marks(fill_middle.MARKS)
    out = fill_middle.scatter(data, offsets, cuts, order, marks)
    back = fill_middle.gather(*out, order, marks)
    assert back[0].tobytes() == data.tobytes() and back[1].tolist() == offsets.tolist()
    for k, (a, b) in enumerate(zip(out[1], out[1][1:])):
        p, m, s = (data[x:y].tobytes() for x, y in zip((offsets[k], *cuts[k]), (*cuts[k], offsets[k + 1])))
        assert out[0][a:b].tobytes() == (b"<P>" + p + b"<S>" + s + b"<M>" + m, b"<S>" + s + b"<P>" + p + b"<M>" + m,
                                         p + m + s)[order[k]]


def test_marks_that_could_not_be_found_again():
    for marks in (("", "<S>", "<M>"), ("<P<", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.checked_marks(marks)


def test_an_output_without_its_marks_stops(spark):
    rows = spark.createDataFrame([("no marks", "psm")], "output string, form string")
    with pytest.raises(Exception, match="lacks a mark"):
        fill_middle.restore(rows).collect()


def plain_phrases(rows, least, top=2000):
    counts, words_of, left, right = {}, Counter(), {}, {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i:i + k]))
                    counts[key] = counts.get(key, 0) + 1
                    left[key] = left.get(key, 0) + (i > 0)
                    right[key] = right.get(key, 0) + (i + k < len(w))
    good = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in good.items():
        longer = [c for (x, v), c in good.items() if x == lang and len(v) > len(w)
                  and any(v[i:i + len(w)] == w for i in range(len(v)))]
        if any(100 * c >= 80 * a for c in longer):
            continue
        score, k = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], words_of[lang], score,
                    left[lang, w], right[lang, w]))
    ranked, place = [], Counter()
    for r in sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        place[r[0]] += 1
        if place[r[0]] <= top:
            ranked.append((r[0], place[r[0]], *r[1:]))
    return ranked


def phrase_rows(seed):
    pick = random.Random(seed)
    vocabulary = ["ab", "É", "c", "ß", "AB", "x\x85y", "zz", "q" * 40]
    rows = []
    for _ in range(120):
        n = pick.choice((0, 1, 3, 20, 60))
        rows.append(("".join(pick.choice(vocabulary) + pick.choice((" ", " ", "  ", "\t", ", ", ".\n", "!")) for _ in range(n)),
                     pick.choice(("en", "en", "en", "de", None, "und"))))
    return rows + [(None, "en"), ("", None), (" \n", "fr"), ("one two three four five " * 30, "de")]


@pytest.mark.parametrize("seed, shard", [(1, 1 << 20), (2, 9), (3, 1)])
def test_phrases_against_brute_force(spark, seed, shard):
    """Also with shards so small that they are closed after each batch of texts."""
    rows = phrase_rows(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, shard int").coalesce(3)
    got = [tuple(r) for r in phrases.collocations(docs, least=4, shard_words=shard).orderBy("lang", "rank").collect()]
    assert got == plain_phrases(rows, 4)
    assert got and phrases.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [16, 50, 1000])
def test_pieces_cut_between_shards_are_counted_once(monkeypatch, chunk):
    monkeypatch.setattr(near_dup, "CHUNK", chunk)
    pick = random.Random(chunk)
    text = " ".join(pick.choice(("a", "bb", "c", "dd")) + pick.choice(("", "", "", ".")) for _ in range(400))
    data = np.frombuffer(text.encode(), np.uint8)
    gathered, found = phrases.Gathered(), Counter()

    def count(words, ids, sign):
        ids = ids.astype(np.uint64)
        index = phrases.Index(ids)
        pairs = np.unique(ids[:-1][(ids[:-1] != 0) & (ids[1:] != 0)] << np.uint64(phrases.ROW_BITS)
                          | ids[1:][(ids[:-1] != 0) & (ids[1:] != 0)])
        level = index.words(np.unique(ids[ids > 0]).astype(np.int64))
        names = words.to_pylist()
        for _ in range(4):
            for w, lo, hi in zip(level.ids, level.lo, level.hi):
                found[" ".join(names[x - 1] for x in w)] += sign * int(hi - lo)
            level = index.extend(level, pairs)

    for words, breaks in phrases.cut(data, np.array([0, len(data)])):
        twice = gathered.add(words, breaks)
        if twice is not None:
            count(*phrases.numbered(twice, np.zeros(len(twice), bool)), -1)
        if gathered.n >= 30:
            count(*gathered.shard()[:2], 1)
    if gathered.n:
        count(*gathered.shard()[:2], 1)
    want = Counter()
    for piece in text.split("."):
        w = piece.split()
        for k in range(1, 5):
            want.update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    assert +found == want


def test_first_of_each_language_and_big_products(spark):
    a = 9 * 10**18
    found = spark.createDataFrame([("en", "a", 1, a, 0, 0), ("en", "b", 1, a, 0, 0), ("en", "a b", 2, a, 0, 0)],
                                  "lang string, phrase string, n_words int, f bigint, to_left bigint, to_right bigint")
    assert phrases.scored(found).first().score == 1_000_000
    rows = spark.createDataFrame([("en", f"p{i:03}", i % 7, 5) for i in range(300)], "lang string, phrase string, score int, a int")
    got = sorted((r.rank, r.phrase) for r in phrases.first_of_each(rows, 20).collect())
    want = sorted(((i % 7, f"p{i:03}") for i in range(300)), key=lambda x: (-x[0], x[1]))[:20]
    assert got == [(k + 1, p) for k, (_, p) in enumerate(want)]


def plain_targets(sizes, weights=(3, 1, 2)):
    """Shares by weight; what is above twice a source's words is shared again among the others."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, target, open_ = Fraction(3, 2) * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_mixing_against_a_plain_version(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    pick = random.Random(5)
    rows = [(i, pick.choice(ODD_TEXTS) if i % 3 else "w " * pick.randint(1, 300), pick.choice(("é", "a", "B", "z", None, "hot", "hot", "hot")), 0)
            for i in range(600)] + [(None, "no id", "a", 1), (None, None, None, 1), (5, "same", "a", 2), (5, "same", "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    target = plain_targets(sizes)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, size(t), sizes[s]) for i, t, s, _ in rows)
    assert all(0 <= r.taken - r.epochs * r.size <= r.size and r.taken <= 2 * r.size for r in got)
    by_target = Counter()
    for r in got:
        by_target[r.target] += r.taken
    assert sorted(by_target) == pytest.approx(sorted({float(t) for t in target.values()}))
    for t, taken in by_target.items():
        assert abs(taken - sum(float(x) for x in target.values() if float(x) == pytest.approx(t))) <= len(sizes)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id int, text string, source string")
    assert sorted(tuple(r) for r in mixing.mix(docs).collect()) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]


def test_keys_follow_quality(spark):
    """Of equal documents, those of the larger weight come first more often, in the proportion of the weights."""
    docs = spark.createDataFrame([(i, "w w w w" if i % 2 else "w w w <|", "s") for i in range(4000)], "doc_id int, text string, source string")
    clean = sorted((r.draw, r.id % 2) for r in mixing.draw(docs, "doc_id", "text", "source", 1).collect())
    first = sum(x for _, x in clean[:200]) / 200
    weight = 4 / (4 + 20 * 2)
    assert first == pytest.approx(1 / (1 + weight), abs=0.05)
    assert math.isclose(weight, 1 / 11)


def test_filling_and_mixing_are_planned_as_declared(spark):
    docs = queries.table(spark, SF, "documents")
    plan = mixing.draw(docs, "doc_id", "text", "source", 42)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
