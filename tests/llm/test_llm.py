"""The training-data operators against brute force, SQL and hand-made cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("kinetra.llm")
from kinetra.llm import bpe, components, decontam, html_text, line_dedup, pii, quality, queries, sharding, simhash, substring, warc  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves.
CLASH = ["key", "tk", "fp", "h", "n", "w", "seq", "shard", "slot", "bucket", "size", "crc", "kept", "spans", "component", "n_lines", "n_removed", "copied_from"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def _docs(spark, *texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def _odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing names."""
    rows = [(1, None, None, None, None), (None, "a b c d e", "en", "s", 9), (None, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t\n", "en", "s", 4), (4, "word " * 30_000, "en", "s", 150_000), (5, "x" * 100_000, "en", "s", 100_000), (6, "same text here\n" * 40, "en", "s", 600), (6, "same text here\n" * 40, "en", "s", 600), (6, "another text", "en", None, 12), (7, "é😀" * 500 + "\n" + "1" * 5000, "fr", "s", 6000)]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


OPERATORS = {
    "sharding": lambda df: sharding.assign_shards(df, sharding.regular_tree(24)),
    "simhash": simhash.simhash_groups,
    "near_dedup": simhash.near_dedup,
    "lines": line_dedup.dedup_lines,
    "pii": pii.find_personal_data,
    "spans": substring.dedup_spans,
    "bpe": lambda df: bpe.encode_decode(df, *bpe.default_vocabulary()),
    "html": lambda df: html_text.extract_text(df, "doc_id", "text"),
    "quality": quality.quality_rules,
    "apply_quality": quality.apply_quality,
    "decontam": lambda df: decontam.find_contamination(df, df.sparkSession.createDataFrame([(1, "word word word"), (2, None), (3, "")], "item_id long, text string")),
    "clean": lambda df: decontam.drop_contaminated(df, df.sparkSession.createDataFrame([(1, "word word word")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    f, odd = OPERATORS[name], _odd(spark)
    out = f(odd)
    n = len(out.collect())
    if name in ("sharding", "simhash", "lines", "pii", "spans", "bpe", "html", "quality", "decontam"):
        assert n == odd.count()
    else:
        assert out.columns == odd.columns and n < odd.count()
    empty = f(odd.where("false"))
    assert empty.columns == out.columns and empty.count() == 0


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_as_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, FOLDER), duck.sql(queries.SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


# 1


def test_shards_move_only_where_weights_change(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    tree = sharding.regular_tree(24)
    light = [x._replace(weight=0.5) if x.shard == 3 else x for x in tree]
    rows = ids.select(sharding.shard_of(F.col("doc_id"), tree).alias("a"), sharding.shard_of(F.col("doc_id"), light).alias("b")).collect()
    sizes = Counter(r["a"] for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) < 1.15 * 20_000 / 24 and min(sizes.values()) > 0.85 * 20_000 / 24
    assert all(r["a"] == 3 for r in rows if r["a"] != r["b"]) and 300 < sum(r["a"] != r["b"] for r in rows) < 550
    out = sharding.assign_shards(ids, tree)
    slots = defaultdict(list)
    for r in out.collect():
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == 8 and r["text_crc32"] == 0
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign_shards(_docs(spark, "é"), tree).first()["text_crc32"] == zlib.crc32("é".encode())


def test_every_count_has_one_tree(spark):
    """For 1 to 64 shards: one more takes rows only into itself, all shards are alike in size, growing is the larger count's tree."""
    ids = spark.range(4000)
    for first in range(1, 65, 16):
        counts = range(first, min(first + 17, 66))
        rows = ids.select(*[sharding.shard_of(F.col("id"), sharding.regular_tree(n)).alias(f"s{n}") for n in counts]).collect()
        for n in counts:
            size = Counter(r[f"s{n}"] for r in rows)
            assert set(size) == set(range(n)) and abs(max(size.values()) * n / 4000 - 1) < 5 * (n / 4000) ** 0.5 + 0.01
            if n + 1 in counts:
                assert all(r[f"s{n + 1}"] in (r[f"s{n}"], n) for r in rows)
    assert all(sharding.grow(sharding.regular_tree(n)) == sharding.regular_tree(n + 1) for n in range(1, 65))


def test_shards_by_weight(spark):
    """Weights below the capacity in several racks: shares by weight."""
    tree = [x._replace(weight=(0.25, 0.5, 1.0)[x.shard % 3]) for x in sharding.regular_tree(19) if x.shard < 19]
    size = Counter(r["s"] for r in spark.range(40_000).select(sharding.shard_of(F.col("id"), tree).alias("s")).collect())
    total = sum(x.weight for x in tree)
    assert all(abs(size[x.shard] / 40_000 - x.weight / total) < 5 * (x.weight / total / 40_000) ** 0.5 for x in tree)


# 2


def _fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(prints: dict):
    """Smallest id reachable by links of at most 4 bits, by comparing all pairs."""
    ids = sorted(prints)
    forest = components.Forest()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                forest.join(a, b)
    return {i: forest.find(i) for i in ids}


def test_covering_masks():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31 and all(28 <= m.bit_count() <= 36 for m in masks)
    rnd = random.Random(1)
    for _ in range(3000):
        bits = rnd.sample(range(64), 4)
        assert any(not m & sum(1 << b for b in bits) for m in masks)


def test_simhash(spark, duck):
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    prints = {i: _fingerprint(t) for i, t in texts.items()}
    want = _classes(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op2_simhash"](spark, FOLDER).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_dense_and_chained_fingerprints(spark):
    rnd = random.Random(2)
    centre, fps = rnd.getrandbits(64), set()
    while len(fps) < 600:
        fps.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))))
    fps |= {rnd.getrandbits(64) for _ in range(200)} | {(1 << 4 * k) - 1 for k in range(17)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, [f]) for f in signed], "node long, fp array<long>")
    for block in (2048, 50):
        roots = simhash.near_components(nodes, block=block)
        got = {r["node"] & (1 << 64) - 1: r["root"] for r in roots.collect()}
        want = _classes(dict(enumerate(fps)))
        groups = defaultdict(set)
        for i, f in enumerate(fps):
            groups[got.get(f, ("alone", f))].add(want[i])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rnd.randrange(5000, 5400), rnd.randrange(5000, 5400)) for _ in range(250)]
    forest = components.Forest()
    for a, b in pairs:
        forest.join(a, b)
    nodes = {x for a, b in pairs for x in (a, b) if a != b}
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: forest.find(x) for x in nodes}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 3


def _lines_brute(docs, least):
    """Lines in a run of at least `least` words that occurs earlier, by looking at every run."""
    seq = {i: [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)] for i, t in docs}
    first, gone = {}, defaultdict(set)
    for i, lines in seq.items():
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x.strip(" \t\n\x0b\x0c\r") for x in lines[a:b])
                if sum(len(x.split()) for x in run) >= least and first.setdefault(run, (i, a)) != (i, a):
                    gone[i] |= set(range(a, b))
    def left(i, text):
        """All other lines as they are, those without words too."""
        at = [n for n, x in enumerate(text.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
        drop = {at[n] for n in gone[i]}
        return "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop)

    return {i: left(i, t) if gone[i] else t for i, t in docs}


def test_line_runs(spark):
    rnd = random.Random(4)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(12)]
    docs = [(i, "\n".join(rnd.choice([*pool, ""]) for _ in range(rnd.randint(0, 14)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, extra string")
    for least in (6, 20):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, min_words=least).collect()}
        assert got == _lines_brute(docs, least)


# 4


def test_lines_outside_of_a_run_stay_as_they_are(spark):
    run = "\n".join(f"line {i} of a run that comes again" for i in range(4))
    first, second = f"head\n\n{run}\n \ntail", f"intro x\n\nsecond para\n\n{run}\n\n\tthird \n\n"
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.dedup_lines(_docs(spark, first, second)).collect()}
    assert got == {0: (first, 0), 1: ("intro x\n\nsecond para\n\n\n\tthird \n\n", 4)}


def test_long_numbers_are_no_addresses():
    text = "0" * 5000 + "1.2.3.4 " + "9" * 5000 + ".2.3.4 1.2.3." + "0" * 9000 + " 1.2.3.256"
    assert [(k, text[a:b].lstrip("0")) for k, a, b in pii.base_spans(text) if k == "ip"] == [("ip", "1.2.3.4"), ("ip", "1.2.3." + "0" * 9000)]


def test_base_spans():
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "phone": lambda: 8 <= len(d) <= 15, "card": lambda: 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0}[kind]()

    rnd = random.Random(5)
    for _ in range(20_000):
        t = "".join(rnd.choice("aB1234567890@@..-+ () %_é\n4444") for _ in range(rnd.randint(1, 40)))
        assert pii.base_spans(t) == [(k, *m.span()) for k, p in pats.items() for m in re.finditer(p, t) if ok(k, m[0])]
    assert pii.base_spans("x 4111 1111 1111 1111 y")[0] == ("card", 2, 21)


def test_contexts_find_more(spark):
    known = [f"text {i} please mail me: user{i}@site{i}.example now" for i in range(8)]
    phones = [f"other {i} my phone is +1 202 555 01{i:02d} ok" for i in range(8)]
    unseen = ["then please mail me: someone@localhost bye", "so my phone is 202-555-0177 ok", "the number is 1234567 here"]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(_docs(spark, *known, *phones, *unseen)).collect()}
    added = {i: [tuple(s) for s in r["added"]] for i, r in rows.items() if r["added"]}
    assert added == {16: [("email", 21, 38)], 17: [("phone", 15, 27)]}
    assert all(len(rows[i]["base"]) == 1 for i in range(16))
    copies = [known[0]] * 20 + unseen  # one seed, copied, proves nothing
    assert not any(r["added"] for r in pii.find_personal_data(_docs(spark, *copies)).collect())


def test_contexts_are_found_over_several_hops(spark):
    hop = lambda words, names: [f"text {words} {n} {n[::-1].strip('@')} bye" for n in names]
    own = lambda k: [f"{k}{i}@host" for i in range(6)]
    texts = hop("please mail", [f"user{i}@site{i}.example" for i in range(20)] + own("a"))
    texts += hop("write to", own("a") + own("b")[:2]) + hop("reach under", own("a") + own("c")[:2])
    chain = hop("contact via", ["x@host"]) + hop("write to", own("d")[:1])
    rows = {r["doc_id"]: r for r in pii.find_personal_data(_docs(spark, *texts, *chain)).collect()}
    assert [len(rows[i]["added"]) for i in range(len(texts))] == [0] * 20 + [1] * 22
    assert [len(rows[len(texts) + i]["added"]) for i in range(2)] == [0, 1]


def _sure_patterns(texts, rounds=3, min_seeds=3, least=0.75):
    """The pattern-instance graph in plain Python."""
    edges = {}
    for t in set(texts):
        for m in pii.mentions(t):
            for p in {m["before"], m["after"]} - {""}:
                edges[p, m["instance"]] = max(filter(None, (m["kind"], edges.get((p, m["instance"])))), default=None)
    found = set()
    while True:
        seeds = Counter((p, k) for (p, i), s in edges.items() for k in ([s] if s else [k for k, x in found if x == i]))
        kinds = defaultdict(list)
        for (p, k), n in seeds.items():
            if n >= min_seeds:
                kinds[p].append(k)
        graph = [(p, k, i, s == k or s is None and (k, i) in found, s is not None) for (p, i), s in edges.items() for k in kinds[p]]
        c = {}
        for _ in range(rounds):
            total, n = Counter(), Counter()
            for p, k, i, own, any_ in graph:
                total[p, k] += 1 if own else 0 if any_ else c.get((k, i), 0)
                n[p, k] += 1
            score = {x: total[x] / (n[x] + 1) for x in n}
            doubt = defaultdict(lambda: 1.0)
            for p, k, i, _, _ in graph:
                doubt[k, i] *= 1 - score[p, k]
            c = {x: 1 - d for x, d in doubt.items()}
        more = {(k, i) for p, k, i, _, any_ in graph if not any_ and c[k, i] >= least} - found
        if not more:
            return {(p, k): s for (p, k), s in score.items() if s >= least} if graph else {}
        found |= more


def test_graph_against_plain_python(spark):
    rnd = random.Random(6)
    n_found = 0
    for _ in range(3):
        texts = []
        for _ in range(150):
            at = rnd.randrange(7)
            one = ["u{0}@s{0}.example", "u{0}@host", "10.0.0.{0}", "+1 202 555 01{0:02d}", "5550{0:03d}77", 'token = "{0:040x}"', "a{0:02d}b1c2d3e4f5{0:02d}a9b8c7d6e5f4a3b2c1"][at].format(rnd.choice([rnd.randrange(6), rnd.randrange(90)]))
            before, after = ["mail me:", "mail me:", "from host", "call", "call", "see x y", "key"], ["now", "bye bye", "z", "ok then"]
            texts.append(f"{rnd.choice(before) if rnd.random() < 0.1 else before[at]} {one} {rnd.choice(after) if rnd.random() < 0.3 else after[at // 2]} {rnd.choice(['a', 'b'])}")
        want = _sure_patterns(texts)
        got = {(r["pattern"], r["kind"]): r["confidence"] for r in pii.sure_patterns(pii.scan(_docs(spark, *texts, *texts[:20]))).collect()}
        assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in got)
        n_found += len(got)
    assert n_found > 5


def test_contexts_on_both_sides(spark):
    long = "w" * 80
    c = pii.Contexts(f"one {long}1.2.3.4 two three")
    assert c.before(84) == "one ~" and c.after(91) == "two three"
    c = pii.Contexts(f'first {long} x, "1.2.3.4", two')
    assert c.before(c.text.index("1.2")) == f"{re.sub('[0-9]', '0', pii._name(long))} x" and c.after(c.text.index('"', 95)) == "two"
    known = [f"at {'abcdefghij'[i]} {'klmnopqrst'[i]} u{i}@s{i}.example is my address" for i in range(8)]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(_docs(spark, *known, "so z y someone@localhost is my address")).collect()}
    assert [tuple(s) for s in rows[8]["added"]] == [("email", 7, 24)]


def test_secrets(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = {r["doc_id"]: r for r in pii.find_personal_data(_docs(spark, *[f'x token = "{key(i)}" y' for i in range(6)], 'z token = "ab12345" y', "z 12345 q")).collect()}
    assert [[tuple(s)[1:] for s in rows[i]["secrets"]] for i in (0, 6, 7)] == [[(11, 51)], [(11, 18)], []] and not any(r["base"] or r["added"] for r in rows.values())


def test_long_candidates(spark):
    long = "n" * 80 + "@host"
    known = [f"text {i} please mail me: user{i}@site{i}.example now" for i in range(8)]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(_docs(spark, *known, f"please mail me: {long} bye")).collect()}
    assert [tuple(s) for s in rows[8]["added"]] == [("email", 16, 16 + len(long))]


def test_pii_query(spark, duck):
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    for r in queries.QUERIES["op4_pii"](spark, FOLDER).collect():
        base = pii.base_spans(texts[r["doc_id"]])
        said = [":".join(map(str, s)) for s in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r["spans"].split(",")) | {""} and r["n_email"] == sum(s[0] == "email" for s in base)


# 5


def _spans_brute(docs, span, least):
    first, gone = {}, defaultdict(set)
    for i, t in docs:
        kept = [(k, s.lower().split()) for k, s in enumerate(substring.sentences(t)) if s.split()]
        for j in range(len(kept) - span + 1):
            run = tuple(tuple(w) for _, w in kept[j : j + span])
            if sum(map(len, run)) >= least and first.setdefault(run, (i, j)) != (i, j):
                gone[i] |= {k for k, _ in kept[j : j + span]}
    return {i: "".join(s for k, s in enumerate(substring.sentences(t)) if k not in gone[i]) for i, t in docs}


def test_spans(spark):
    rnd = random.Random(6)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) + rnd.choice([". ", "! ", ".\n", "?"]) for _ in range(15)]
    docs = [(i, "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    assert all("".join(substring.sentences(t)) == t for _, t in docs)
    got = {r["doc_id"]: r["text"] for r in substring.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _spans_brute(docs, 2, 10)


def test_passage_goes_from_later_documents(spark):
    passage = "One two three four five six seven eight nine ten. " * 1 + "Eleven twelve thirteen fourteen fifteen sixteen. " + "Alpha beta gamma delta epsilon zeta eta theta iota kappa. "
    rows = {r["doc_id"]: r for r in substring.dedup_spans(_docs(spark, "Start here. " + passage + "End one.", "Other words stand. " + passage + "And an end.", "Clean text of its own.")).collect()}
    assert rows[0]["n_removed"] == 0 and rows[1]["text"] == "Other words stand. And an end." and rows[1]["copied_from"] == [0] and rows[2]["n_removed"] == 0


def test_unpunctuated_passages_at_other_offsets(spark):
    rnd = random.Random(13)
    words = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    texts = []
    for n in range(40):
        passage = words(60)
        texts += [" ".join(words(7 + n % 3) + passage + words(30)), "  ".join([w.upper() for w in words(12 + n % 20)] + passage + words(9))]
    assert all("".join(substring.sentences(t)) == t for t in texts)
    assert all(1 <= len(p.split()) <= substring.LONGEST for t in [*texts, "word " * 999, "a b c d e " * 99] for p in substring.sentences(t))
    rows = {r["doc_id"]: r for r in substring.dedup_spans(_docs(spark, *texts)).collect()}
    gone = [len(texts[i].split()) - len(rows[i]["text"].split()) for i in range(1, 80, 2)]
    assert all(rows[i]["n_removed"] == 0 for i in range(0, 80, 2)) and min(gone) >= 20 and sum(gone) / 40 >= 35 and max(gone) <= 60
    assert all(rows[i]["copied_from"] == [i - 1] for i in range(1, 80, 2))


def test_repeating_words_are_cut_alike():
    parts = [substring.sentences("x " * n + "a b c d e " * 60) for n in (0, 7, 12)]
    assert all(set(p[3:-3]) <= set(parts[0]) for p in parts)


# 6


@pytest.fixture(scope="module")
def codec():
    path, pattern, ascii = bpe.default_vocabulary()
    return bpe.Codec(bpe.load_ranks(path), pattern, ascii)


def test_same_as_tiktoken(codec, duck):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern, _ = bpe.default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rnd = random.Random(7)
    texts = [t for (t,) in duck.sql("select text from documents").fetchall()]
    texts += ["".join(rnd.choice("aeionrst hTH'  .,01\n\r\t\x1c\x85éß漢字😀<|endoftext|>") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(map(chr, range(128))), "a" * 3000, " " * 3000, "ab" * 2000, "é" * 1000, "don't we'll I'M", "x  y   \n\n z"]
    for t in texts:
        ids = codec.encode(t).tolist()
        assert ids == enc.encode_ordinary(t)
        assert codec.decode(ids) == t


def test_streaming_decode():
    run = bpe.Utf8Stream.run
    for data in ("aé漢😀".encode(), b"\xff\xc3(\xe2\x82", b"\xed\xa0\x80\xf4\x90\x80\x80", bytes(range(256))):
        for cut in range(len(data) + 1):
            state, a = run(b"", data[:cut])
            state, b = run(state, data[cut:])
            assert a + b + "�" * bool(state) == data.decode("utf-8", "replace")


def test_bpe_query(spark, codec, duck):
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    for r in queries.QUERIES["op6_bpe"](spark, FOLDER).collect():
        t = texts[r["doc_id"]]
        ids = codec.encode(t).tolist()
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


# 7

HTML = [
    ("<p>one<p>two <b>bold</b>x", "one\n\ntwo boldx"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22</table>", "Name   N\nalpha  1\nb      22"),
    ("<head><title>T</title></head><body><script>var a='<p>'</script><style>p{}</style>seen<div hidden>no</div><p style='display: none'>no</p>", "seen"),
    ("a<br>b&amp;&eacute;<!-- no -->c", "a\nb&éc"),
    ("<pre>a  b\n c</pre>", "a  b\n c"),
    ("<div>a</div><div>b</div></p></b>", "a\nb"),
    ("a <b>x", "a x"),
    ("1 < 2 &lt; 3", "1 < 2 < 3"),
    ("<!-- open", ""),
    ("<script>open", ""),
    ("", ""),
]


@pytest.mark.parametrize(("page", "text"), HTML)
def test_html(page, text):
    assert html_text.visible_text(page) == text


LOST = [
    ("<table><tbody><td>x<td>y</table>", "x  y"),
    ("<table><td>x</td></table>z", "x\n\nz"),
    ("<table><tr><form><td>x</td></form><td>y</td></tr></table>", "x  y"),
    ("<table><tbody><form><tr><td>x</td></tr></form><tr><td>y</table>", "x\ny"),
    ("a<table><tbody>b<tr>c<td>x</td><b>d</b></tr></table>", "abcd\n\nx"),
    ("<table><caption>t</caption><tr><div>b</div><td>x</table>", "b\n\nt\nx"),
    ("<table hidden>b<tr><td>x</table>", "b"),
    ("<table><tr><td>a<table><td>b</table>c</td><td>d</table>", "a b c  d"),
    ("<table><template><tr><td>no</template><tr><td>x</table>", "x"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
    ("a<svg><title>no</title><defs><text>no</text></defs>no<g><text>b</text><text>c<tspan>d</tspan></text></g></svg>e", "a b cd e"),
    ("<select><option>one<option>two</select>x", "one two x"),
    ("<b>" * 600 + "<p>a<p>b<ul><li>c</ul><table><tr><td>x<td>y</table><div hidden>no</div><script>no</script>z", "a\n\nb\n\n- c\n\nx  y\n\nz"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>end", "deep\n\nend"),
    ("<table><tr><td>" * 2000 + "deep", "deep"),
]


@pytest.mark.parametrize(("page", "text"), LOST)
def test_no_visible_text_is_lost(page, text):
    assert html_text.visible_text(page) == text


def _shown_words(page):
    """Words of the text outside of what isn't shown, by Python's own parser."""
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        off, out = 0, ""

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title", "template", "noscript")
            self.out += "" if tag in ("a", "b", "i", "em", "span", "strong", "u", "code", "sup", "sub", "small", "font") else " "

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title", "template", "noscript")
            self.out += "" if tag in ("a", "b", "i", "em", "span", "strong", "u", "code", "sup", "sub", "small", "font") else " "

        def handle_data(self, data):
            self.out += "" if self.off else data

    parser = Parser()
    parser.feed(page or "")
    parser.close()
    return re.findall(r"[^ \t\n\f\r]+", parser.out)


def test_every_word_of_the_given_pages(spark):
    """The whole query: each visible word once and in order; bullets and numbers of lists are added."""
    folder = FOLDER.replace("0.001", "0.01")
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.QUERIES["op7_html"](spark, folder).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        said = [w for line in r["text"].split("\n") for w in re.sub(r"^ *(?:-|[0-9]+\.) ", "", line).split()]
        assert said == _shown_words(pages[r["page_id"]])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<head><title>T</title><div>Hello</div><p>World</p>", "Hello\n\nWorld"),
        ("<head><script>x</script>text here", "text here"),
        ("<p>a<head>b", "ab"),
        ("<table><tr><td colspan=2>wide</td><td>z</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>", "wide  z\na  b  c"),
        ("<table><tr><td rowspan=2>tall</td><td>x</td></tr><tr><td>y</td></tr></table>", "tall  x\n      y"),
        ("<table><tr><td colspan=2>a long title</td></tr><tr><td>a</td><td>b</td></tr></table>", "a long title\na  b"),
        ("<table><tr><td rowspan=0>t</td><td>x</td></tr><tr><td>y</td></tr><tr><td>z</td></tr></table>", "t  x\n   y\n   z"),
        ('<div style="visibility:hidden">no <span style="visibility:visible">yes</span></div>', "yes"),
        ('<div style="display:none">no <span style="visibility:visible">no</span></div>x', "x"),
        ('<table style="visibility:hidden"><tr><td>no</td><td style="visibility:visible">yes</td></table>', "yes"),
    ],
)
def test_heads_spans_and_visibility(page, text):
    assert html_text.visible_text(page) == text


def test_deep_html_is_linear():
    for s in ("<div>" * 30_000 + "</b>" * 30_000, "<b>" * 30_000 + "<li>" * 30_000, "<span>" * 30_000 + "<dt>x" * 20_000, "<ul><li>x" * 5_000, "<table><td>" * 10_000):
        html_text.visible_text(s)


def test_html_is_linear():
    for s in ("<" * 100_000, "<a " * 30_000, "<div>" * 30_000, "<p>" * 30_000, '<a b="' * 20_000, "<li>" * 20_000):
        html_text.visible_text(s)
    assert html_text.visible_text(None) == ""


# 8


@pytest.mark.parametrize("rows", [lambda n: f"<tr><td>{'x' * n}<td>y" + "<tr><td>a<td>b" * (n // 14), lambda n: "<tr>" + "<td>w" * (n // 5) + f"<tr><td colspan={n // 5}><td>z" * (n // 24)])
def test_text_of_a_table_is_no_more_than_some_times_its_size(rows):
    for n in (4_000, 200_000):
        page = f"<table>{rows(n)}</table>"
        text = html_text.visible_text(page)
        assert len(text) < 12 * len(page)
        assert all(Counter(text)[c] == Counter(re.sub("<[^>]*>", "", page))[c] for c in "xyabwz")


def test_long_cells_move_their_own_row_only():
    page = f"<table><tr><td>{'x' * 90}<td>1<td>2<tr><td>a<td>b<td>c</table>"
    assert html_text.visible_text(page).split("\n") == ["x" * 90 + "  1  2", "a" + " " * 61 + "b  c"]


def test_quality(spark):
    rnd = random.Random(8)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    menu = "Home | About | Contact | Privacy | Terms"
    texts = [f"{prose(60)}\n{menu}" for _ in range(40)] + ["\n".join([menu] * 12)] + [prose(20)] + [" ".join(["a b c"] * 40)] + ["# " * 10 + prose(60)] + [f"{menu}\n{prose(70)}\n{menu}\n{menu}"]
    rows = {r["doc_id"]: r for r in quality.quality_rules(_docs(spark, *texts)).collect()}
    assert [rows[i]["kept"] for i in (0, 5, 40, 41, 42, 43, 44)] == [True, True, False, False, False, True, False]
    assert not rows[44]["base_failed"] and rows[44]["n_removed_words"] == 27  # depleted
    assert rows[0]["n_removed_words"] == 9 and rows[43]["n_removed_words"] == 0 and rows[43]["n_symbols"] == 10
    assert rows[42]["n_repeat_words"] == 120 and rows[40]["n_dup_lines"] == 11
    kept = {r["doc_id"]: r["text"] for r in quality.apply_quality(_docs(spark, *texts)).collect()}
    assert not any(menu in t for t in kept.values()) and set(kept) == {*range(40), 43}
    copies = _docs(spark, *[texts[0]] * 30)  # copies of one text hold no line of several documents
    assert all(r["kept"] and not r["n_removed_words"] for r in quality.quality_rules(copies).collect())
    two = _docs(spark, *texts).withColumn("source", F.explode(F.array(F.lit("a"), F.lit("b"))))
    assert sorted((r["doc_id"], r["kept"]) for r in quality.quality_rules(two).collect()) == sorted((i, r["kept"]) for i, r in rows.items() for _ in range(2))


def test_both_ways_of_finding_repeats(spark, monkeypatch):
    rnd = random.Random(9)
    df = _docs(spark, *[" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 120))) for _ in range(40)])
    a = sorted(map(tuple, quality.base_rules(df).collect()))
    monkeypatch.setattr(quality, "SORT_ABOVE", 3)
    assert sorted(map(tuple, quality.base_rules(df).collect())) == a


# 9


def test_warc_with_magic_in_payloads(spark, tmp_path):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a", "hello"), (2, None, trap), (3, "http://c", "x" + trap * 3 + "WARC/1.1\r\n"), (4, "http://d", "hello"), (5, "http://e", None), (6, "http://f", ""), (7, "http://g\r\nWARC-Type: fake", trap), (8, "u", "é😀")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    path = f"{tmp_path}/w"
    records = warc.archive_and_read(df, path).collect()
    assert len(records) == len(pages)
    by = {int(re.search(r"page:(\d+)", r["headers"]["warc-record-id"])[1]): r for r in records}
    assert {i: r["headers"]["warc-type"] for i, r in by.items()} == {1: "response", 2: "response", 3: "response", 4: "revisit", 5: "response", 6: "revisit", 7: "revisit", 8: "response"}
    assert bytes(by[2]["payload"]).decode() == trap and bytes(by[3]["payload"]).decode() == pages[2][2] and bytes(by[8]["payload"]).decode() == "é😀"
    digest = base64.b32encode(hashlib.sha1(trap.encode()).digest()).decode()
    assert by[2]["headers"]["warc-payload-digest"] == f"sha1:{digest}"
    warc.write_archives(df.where("false"), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_warc_with_null_ids(spark, tmp_path):
    pages = [(None, "u", "first"), (1, "u", "one"), (None, None, "middle"), (2, "u", "one"), (None, "u", "one"), (None, "u", "first"), (3, "u", None), (None, "u", None), (4, "u", "last")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.QUERIES["op9_warc"](spark, str(tmp_path)).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"one": 1, None: 3}
    want = [(i, len(t or ""), digest(t), *(("revisit", first[t]) if t in first and first[t] != i else ("response", None))) for i, _, t in pages]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


# 10


def _contaminated(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = find(text), set(), set()
    for item, t in items:
        w = find(t)
        m = min(10, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1) if m else ():
            if tuple(words[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_wu_manber(spark):
    rnd = random.Random(10)
    text = lambda a, b: "".join(rnd.choice(["a", "b", "C", "é"]) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(rnd.randint(a, b)))
    items = [(i, text(0, 16)) for i in range(12)]
    docs = [(i, text(0, 200)) for i in range(40)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (20_000_000, 10):  # in one pass, and in many
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.find_contamination(df, bench, max_words=most).collect()}
        assert got == {i: _contaminated(t, items) for i, t in docs}
        kept = {r["doc_id"] for r in decontam.drop_contaminated(df, bench, max_words=most).collect()}
        assert kept == {i for i, t in docs if not _contaminated(t, items)[1]}


def test_parts_give_the_same_rows(spark):
    a, b = "one two three four five six seven eight nine ten", "red green blue cyan pink grey gold teal plum lime"
    bench = spark.createDataFrame([(1, a + " eleven"), (2, b), (3, "zero " + a)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + a + " eleven y"), (1, "x " + a + " eleven y"), (1, " ".join("abcdefghijklm")), (None, b + " x"), (None, "x " + b), (None, None), (None, None), (2, "zero " + a + " eleven"), (3, a + " " + b)], "doc_id long, text string")
    rows = lambda most: sorted(map(tuple, decontam.find_contamination(docs, bench, max_words=most).collect()), key=repr)
    whole = rows(1000)
    assert len(whole) == 9 and rows(8) == whole
    assert sum(r[2] > 0 for r in whole) == 6


def test_long_items_are_cut_without_loss(spark):
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abc") for _ in range(3))
    item = [word() for _ in range(300)]
    docs = _docs(spark, *[" ".join([*(word() for _ in range(5)), *item[i : i + 10], *(word() for _ in range(5))]) for i in range(0, 291, 3)], *[" ".join(word() for _ in range(40)) for _ in range(20)])
    bench = spark.createDataFrame([("x", " ".join(item)), ("y", "a b"), (None, " ".join(item[100:115]))], "item_id string, text string")
    want = sorted(map(tuple, decontam.find_contamination(docs, bench).collect()), key=repr)
    assert sorted(map(tuple, decontam.find_contamination(docs, bench, max_words=40).collect()), key=repr) == want
    clean = {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()}
    assert clean == {r["doc_id"] for r in decontam.drop_contaminated(docs, bench, max_words=40).collect()} == {r[0] for r in want if not r[2]}


def test_parts_of_a_benchmark_are_bounded_and_never_empty(spark):
    rows = [(7, "the same few words here")] * 400 + [(i, f"item {i} " + "word " * (i % 30)) for i in range(0, 100, 9)] + [(8, None), (None, "no id")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    parts = [p for p, only in decontam._parts(bench, "item_id", "text", 10, 50)]
    assert all(len(p) == 1 or p and sum(len(t) for _, t in p) <= 100 for p in parts) and all(len(t.split()) <= 59 for p in parts for _, t in p) and len(parts) < 20
    assert {i for p in parts for i, _ in p} == {None, "7", *map(str, range(0, 100, 9))}
    assert len([1 for p in parts for i, t in p if t == "the same few words here"]) == 1
    docs = _docs(spark, "the same few words here", "item 63 word word word", "clean")
    many = decontam.find_contamination(docs, bench, max_words=50).orderBy("doc_id").collect()
    assert many == decontam.find_contamination(docs, bench).orderBy("doc_id").collect() and many[0]["n_hit"] == 5
    assert decontam.drop_contaminated(docs, bench, max_words=50).collect() == decontam.drop_contaminated(docs, bench).collect()


def test_items_of_null_id(spark, tmp_path):
    a, b, c = "one two three four five six seven eight nine ten", "red green blue cyan pink grey gold teal plum lime", "jan feb mar apr may jun jul aug sep oct"
    spark.createDataFrame([(None, a), (None, b), (7, c)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _docs(spark, "x " + a, f"{a} {b} {c}", c, "clean").write.parquet(f"{tmp_path}/documents.parquet")
    bench, docs = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("benchmark", "documents"))
    for most in (1000, 8):
        got = {r["doc_id"]: (r["n_hit"], r["items"], r["n_items"]) for r in decontam.find_contamination(docs, bench, max_words=most).collect()}
        assert got == {0: (10, [], 1), 1: (30, ["7"], 2), 2: (10, ["7"], 1), 3: (0, [], 0)}
        assert [r["doc_id"] for r in decontam.drop_contaminated(docs, bench, max_words=most).collect()] == [3]
    c = duckdb.connect()
    for t in ("benchmark", "documents"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES["op10_decontamination"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(queries.SQL["op10_decontamination"]).fetchall())
