"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

A task scans each text for seeds (base spans, and secrets: tokens of 32 letters and digits or more, mixed) and for candidates:
other tokens with an @ or at least five digits. Both carry their contexts: the two words before, and the two words after.
Contexts (patterns) and strings (instances) form a graph for each kind. Seeds have confidence 1; in each round a pattern's
confidence is the mean of its instances' (unknown ones count 0, and one doubt is added), and an instance's is
1 - product(1 - confidence) over its patterns. Only patterns with at least min_seeds distinct seeds take part. After `rounds`
rounds the instances of at least min_confidence become seeds of their kind themselves, which may admit further patterns, and
the rounds begin again, until no seed is new: seeds are never taken back, so this ends. Then candidates that stand behind or
before a pattern of at least min_confidence become spans of the surest one's kind. The graph holds distinct (pattern, instance)
pairs, so copies of a text add nothing to it.

Words are separated by white space and by , ; | " ' < > ( ) [ ], and = and : are words; A-Z are lower-cased, digits are 0. A word
of more than 64 characters goes by a hash; so do long instances. Of the word that an identifier stands in, what is before or
after it is a word of the context, or the mark ~ if it has more than 64 characters.

Edge cases: null and empty texts have no spans; an identifier without words before (after) has no context there; repeated rows
come back repeated and count once; a null key is passed through; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, read, text_key

KINDS = ("email", "ip", "card", "phone")
#: Seeds of the method that are no base spans.
SECRET = "secret"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[@0-9]")
_PART = re.compile(r"[^\s\"'<>|=;]+")
_ENDS_PART = frozenset("\"'<>|=;")
_WORD = re.compile(r"[^\s,;|\"'<>()\[\]=:]+|[=:]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+]{32,}(?![A-Za-z0-9_+/-])")
_DIGIT = re.compile(r"[0-9]")
_LONG = 64
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @ the characters of a local part before it and a domain behind; linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; leftmost matches that don't overlap, and of these the valid ones."""
    text = text or ""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def secrets(text: str) -> list[tuple[str, int, int]]:
    """Tokens of at least 32 letters and digits, six of each at least."""
    out = []
    for m in _SECRET.finditer(text):
        digits = len(_DIGIT.findall(m[0]))
        if digits >= 6 and sum(c.isalpha() for c in m[0]) >= 6:
            out.append((SECRET, *m.span()))
    return out


class Contexts:
    """The contexts of places in one text; each word is looked at once."""

    def __init__(self, text: str) -> None:
        self.text, self.spans = text, [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in self.spans], [b for _, b in self.spans]
        self.names: dict[int, str] = {}

    def _word(self, a: int, b: int) -> str:
        return _DIGIT.sub("0", _name(self.text[a:b])).strip(".!?")

    def _named(self, i: int) -> str:
        if (name := self.names.get(i)) is None:
            name = self.names[i] = self._word(*self.spans[i])
        return name

    def before(self, at: int) -> str:
        """The two words before a place."""
        i, words = bisect_left(self.starts, at) - 1, []
        if i >= 0 and self.ends[i] > at:  # at is inside a word
            words.append("~" if at - self.starts[i] > _LONG else self._word(self.starts[i], at))
            i -= 1
        while i >= 0 and sum(map(bool, words)) < 2:
            words.append(self._named(i))
            i -= 1
        return " ".join(w for w in words[::-1] if w)

    def after(self, at: int) -> str:
        """The two words after a place."""
        i, words = bisect_right(self.ends, at), []
        if i < len(self.spans) and self.starts[i] < at:
            words.append("~" if self.ends[i] - at > _LONG else self._word(at, self.ends[i]))
            i += 1
        while i < len(self.spans) and sum(map(bool, words)) < 2:
            words.append(self._named(i))
            i += 1
        return " ".join(w for w in words if w)


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens with an @ or five digits, without punctuation at their ends, that touch no base span."""
    spans = sorted((a, b) for _, a, b in taken)
    out, i, done = [], 0, 0
    while m := _SIGN.search(text, done):
        a, b = m.start(), _PART.match(text, m.start()).end()
        while a > done and text[a - 1] not in _ENDS_PART and not text[a - 1].isspace():
            a -= 1
        done = b
        while a < b and text[a] in "([{.,:!?":
            a += 1
        while b > a and text[b - 1] in ")]}.,:!?":
            b -= 1
        token = text[a:b]
        if not ("@" in token[1:-1] or sum("0" <= c <= "9" for c in token) >= 5):
            continue
        while i < len(spans) and spans[i][1] <= a:
            i += 1
        if i == len(spans) or spans[i][0] >= b:
            out.append((a, b))
    return out


def _name(instance: str) -> str:
    """What tells an instance from others: itself in lower case, or a hash of it if it is long."""
    low = instance.lower()
    return low if len(low) <= _LONG else "# " + xxhash.xxh3_128_hexdigest(low.encode("utf-8", "surrogatepass"))


_MENTION = "struct<kind:string,start:int,end:int,before:string,after:string,instance:string>"


def mentions(text: str | None) -> list[dict]:
    """Base spans, secrets and candidates (kind null) of a text, in this order, with their contexts and instances."""
    text = text or ""
    seeds = base_spans(text)
    taken = sorted((a, b) for _, a, b in seeds)
    ends = list(accumulate((b for _, b in taken), max))
    for kind, a, b in secrets(text):
        i = bisect_left(taken, (b, 0))
        if not i or ends[i - 1] <= a:
            seeds.append((kind, a, b))
    every = [*seeds, *((None, a, b) for a, b in candidates(text, seeds))]
    if not every:
        return []
    near = Contexts(text)
    out = []
    for k, a, b in every:
        before, after = near.before(a), near.after(b)
        out.append({"kind": k, "start": a, "end": b, "before": before and f"{before} _", "after": after and f"_ {after}", "instance": _name(text[a:b])})
    return out


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tk and mentions of every row."""
    kinds = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("before", pa.string()), ("after", pa.string()), ("instance", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = pa.array([mentions(t.as_py()) for t in part.column(2)], pa.list_(kinds))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], names=["key", "tk", "mentions"])

    kind = dict(df.dtypes)[key]
    slim = df.select(F.col(key).alias("key"), text_key(F.col(text)).alias("tk"), F.col(text).cast("string").alias("text"))
    return slim.transform(map_arrow, run, f"key {kind}, tk long, mentions array<{_MENTION}>")


def _patterns(mention: str) -> Column:
    """The contexts that a mention has."""
    return F.explode(F.filter(F.array(f"{mention}.before", f"{mention}.after"), lambda x: x != ""))


def _scores(edges: DataFrame, found: DataFrame | None, rounds: int, min_seeds: int) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, p) and (kind, instance, any, c) after some rounds; seeds are those of edges and found (kind, instance)."""
    seeds = edges.where("seed is not null").select("pattern", F.col("seed").alias("kind"), "instance")
    if found is not None:
        seeds = seeds.union(edges.where("seed is null").join(found, "instance").select("pattern", "kind", "instance"))
    pairs = seeds.groupBy("pattern", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds).select("pattern", "kind")
    # One copy of a pattern's edges for each kind that it may stand for; at most five.
    graph = edges.join(pairs, "pattern").select("pattern", "kind", "instance", (F.col("seed") == F.col("kind")).alias("own"), F.col("seed").isNotNull().alias("any"))
    if found is not None:
        graph = graph.join(found.withColumn("was", F.lit(True)), ["kind", "instance"], "left").select("pattern", "kind", "instance", (F.coalesce("own", F.lit(False)) | F.coalesce("was", F.lit(False))).alias("own"), "any")
    graph = materialize(graph)
    sure = F.when(F.coalesce("own", F.lit(False)), 1.0).when(F.col("any"), 0.0).otherwise(F.coalesce("c", F.lit(0.0)))
    patterns = scores = None
    for _ in range(rounds):
        known = graph.withColumn("c", F.lit(None).cast("double")) if scores is None else graph.join(scores.drop("any"), ["kind", "instance"], "left")
        new = materialize(known.groupBy("pattern", "kind").agg((F.sum(sure) / (F.count("*") + 1)).alias("p")))
        doubt = F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9))))
        after = materialize(graph.join(new, ["pattern", "kind"]).groupBy("kind", "instance").agg(F.max("any").alias("any"), (1 - F.exp(doubt)).alias("c")))
        if patterns is not None:
            discard(patterns, scores)
        patterns, scores = new, after
    discard(graph)
    return patterns, scores


def sure_patterns(scanned: DataFrame, rounds: int = 3, min_seeds: int = 3, min_confidence: float = 0.75) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that the bootstrapping accepts."""
    edges = scanned.select(F.explode("mentions").alias("m")).select(_patterns("m").alias("pattern"), "m.instance", "m.kind")
    edges = materialize(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))
    found = None
    while True:
        patterns, scores = _scores(edges, found, rounds, min_seeds)
        more = scores.where(~F.col("any") & (F.col("c") >= min_confidence)).select("kind", "instance")
        if found is not None:
            more = more.join(found, ["kind", "instance"], "left_anti")
        more = materialize(more)
        discard(scores)
        if not more.take(1):
            sure = materialize(patterns.where(F.col("p") >= min_confidence).select("pattern", "kind", F.col("p").alias("confidence")))
            discard(edges, patterns, more, *([found] if found is not None else []))
            return sure
        discard(patterns)
        if found is None:
            found = more
        else:
            both = materialize(found.union(more))
            discard(found, more)
            found = both


def find_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 3, min_seeds: int = 3, min_confidence: float = 0.75) -> DataFrame:
    """key, base, added and secrets of every row: arrays of (kind, start, end); code points, end exclusive.

    base and added are of the four kinds; secrets are both the seeds of that kind and what contexts found.
    """
    scanned = materialize(scan(df, key, text))
    patterns = sure_patterns(scanned, rounds, min_seeds, min_confidence)
    best = materialize(patterns.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("b")))
    discard(patterns)
    unknown = scanned.select("key", "tk", F.explode("mentions").alias("m")).where("m.kind is null").select("key", "tk", "m.start", "m.end", _patterns("m").alias("pattern"))
    added = unknown.join(best, "pattern").groupBy("key", "tk", "start", "end").agg(F.max("b").alias("b")).groupBy("key", "tk").agg(F.collect_list(F.struct("b.kind", "start", "end")).alias("added"))
    spans = lambda own: F.transform(F.filter("mentions", lambda m: own(m["kind"])), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    added = added.withColumnRenamed("key", "k2").withColumnRenamed("tk", "t2")
    rows = scanned.join(added, F.col("key").eqNullSafe(F.col("k2")) & F.col("tk").eqNullSafe(F.col("t2")), "left")
    rows = rows.withColumn("added", F.coalesce("added", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")))
    secret = F.concat(spans(lambda k: k == SECRET), F.filter("added", lambda s: s["kind"] == SECRET)).alias("secrets")
    return rows.select(F.col("key").alias(key), spans(lambda k: k != SECRET).alias("base"), F.filter("added", lambda s: s["kind"] != SECRET).alias("added"), secret)


def _joined(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start."""
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document; counts by kind are of the base spans, n_added of those of the same kinds that contexts found.

    n_secret counts the secrets, which are in secret_spans and not in spans; n_found counts all.
    """
    rows = find_personal_data(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n = {c: F.size(c).cast("long") for c in ("base", "added", "secrets")}
    places = F.array_join(F.transform(F.array_sort("secrets"), lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return rows.select(
        "doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"),
        n["added"].alias("n_added"), n["secrets"].alias("n_secret"), places.alias("secret_spans"), (n["base"] + n["added"] + n["secrets"]).alias("n_found"),
    )
