"""Secret scan, native DataFrame operations only: candidate strings, and a random forest that removes false positives.

Candidates are all runs of 16 or more key characters within a word. The forest sees length, changes of character class, how probable the
transitions between characters are, digit and capital shares, distinct characters, coverage by dictionary words, the path, and the
neighbouring words. Transitions and dictionary are learned from the scanned texts themselves: the dictionary holds every run of letters
that follows several different runs (copies of one text add no context, so a copied secret is no word), the transitions are those
within its words. The forest is grown from labelled findings, one aggregation a level for all trees: sums of weights by tree, node,
feature and bin, whose number the forest's size bounds. Bootstrap weights and feature choices come from hashes, so the same findings
give the same forest on any cluster.
"""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

LEAST = 16
RUN = f"[A-Za-z0-9+/_.-]{{{LEAST},}}={{0,2}}"
#: What parts the fields of a word that holds several candidates.
PARTS = ",;&?{}\\[\\]"
BINS = 16
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"
CONTEXTS = 4  # different runs before a run of letters that make it a word
#: Plain words for examples of identifiers where no corpus has been learned from.
PLAIN = ["order", "total", "customer", "report", "window", "number", "account", "summer", "invoice", "garden", "status", "picture", "country", "message", "building", "weather"]
KEYWORDS = "(?i)token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private"
BENIGN = "(?i)sha|commit|uuid|guid|hash|checksum|digest|etag|example|dummy|sample|version|card|phone"
TESTPATH = "(?i)test|example|sample|fixture|docs?/|mock"
FEATURES = ("length", "changes", "transitions", "digits", "capitals", "distinct", "dictionary", "path", "words", "assigned")


@dataclass(eq=False)
class Corpus:
    """What was learned from texts: words (word, n, contexts), log-probabilities of transitions by symbol pair, and some frequent words."""

    words: DataFrame | None
    logs: list[float]
    frequent: list[str]


NOTHING = Corpus(None, [-math.log(len(SYMBOLS) + 1)] * (len(SYMBOLS) + 1) ** 2, PLAIN)


def learned(docs: DataFrame, frequent: int = 2000) -> Corpus:
    """The dictionary and the character transitions of all texts of docs (text); `frequent` bounds the words that examples are made of."""
    runs = F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[^a-z]+"), lambda w: w != "")
    rows = docs.select(F.explode(F.array(runs)).alias("w"))
    one = lambda x, i: F.struct(x.alias("word"), F.pmod(F.xxhash64(F.get(F.col("w"), i - 1)), F.lit(62)).cast("int").alias("k"))
    rows = rows.select(F.explode(F.transform("w", one)).alias("r")).select("r.word", F.expr("shiftleft(1L, r.k)").alias("bit")).where("length(word) between 3 and 40")
    words = rows.groupBy("word").agg(F.count("*").alias("n"), F.bit_count(F.bit_or("bit")).alias("contexts"))
    words = written(words.where(F.col("contexts") >= CONTEXTS), "secret-words")
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    counts = {r["pair"]: r["n"] for r in words.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).collect()}
    size, of = len(SYMBOLS) + 1, {}
    for (a, _), n in counts.items():
        of[a] = of.get(a, 0) + n
    symbols = "\0" + SYMBOLS
    logs = [max(-8.0, math.log((counts.get(a + b, 0) + 0.5) / (of.get(a, 0) + 0.5 * size))) for a in symbols for b in symbols]
    top = [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(frequent).collect()]
    return Corpus(words, logs, top if len(top) >= len(PLAIN) else PLAIN)


def with_coverage(found: DataFrame, corpus: Corpus) -> DataFrame:
    """Add covered: the share of cand that dictionary words make up, each run of letters between signs, digits and changes of case taken whole."""
    if corpus.words is None:
        return found.withColumn("covered", F.lit(0.0))
    split = F.split(F.lower(F.regexp_replace("cand", "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    parts = found.select("cand").distinct().select("cand", F.explode(split).alias("word")).where("length(word) > 2")
    known = parts.join(corpus.words.select("word"), "word").groupBy("cand").agg(F.sum(F.length("word")).alias("letters"))
    return found.join(known, "cand", "left").withColumn("covered", F.coalesce("letters", F.lit(0)) / F.length("cand")).drop("letters")


def transitions(corpus: Corpus) -> Column:
    """Mean log-probability of cand's successive characters."""
    size = len(SYMBOLS) + 1
    table = literal(corpus.logs, "array<double>")
    of = F.transform(F.split(F.lower("cand"), ""), symbol)
    steps = F.zip_with(F.slice(of, 1, F.length("cand") - 1), F.slice(of, 2, F.length("cand") - 1), lambda a, b: F.get(table, a * size + b))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.length("cand") - 1, F.lit(1))


def symbol(c: Column) -> Column:
    """Place of a character among the symbols, 0 for any other."""
    return F.call_function("instr", F.lit(SYMBOLS), c)


def features(corpus: Corpus) -> Column:
    """Bins of all features, from columns cand, raw, before, before2, after, path, covered."""
    n, cand = F.length("cand"), F.col("cand")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(cand, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    share = lambda x: F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(x * BINS).cast("int")))
    without = lambda pattern: (n - F.length(F.regexp_replace(cand, pattern, ""))) / n
    near = F.concat_ws(" ", "before2", "before", "raw")
    words = F.when(near.rlike(KEYWORDS), 1).otherwise(0) + F.when(F.concat_ws(" ", "before2", "before", "after").rlike(BENIGN), 2).otherwise(0)
    return F.array(
        F.least(F.lit(BINS - 1), F.floor(n / 4).cast("int")), share(F.length(kinds) / n), share((transitions(corpus) + 8) / 7), share(without("[0-9]")), share(without("[A-Z]")),
        share(F.size(F.array_distinct(F.split(cand, ""))) / F.least(n, F.lit(32))), share(F.col("covered")),
        F.when(F.coalesce(F.col("path"), F.lit("")).rlike(TESTPATH), 1).otherwise(0), words,
        F.when(F.coalesce(F.col("before"), F.lit("")).rlike("[=:]$") | F.col("raw").rlike("[=:]"), 2).when(F.col("raw").rlike("^[\"'`]"), 1).otherwise(0),
    ).cast("array<int>")


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, word_no (from 1), cand, raw, before, before2, after, path of every candidate in the whole texts.

    A word with several candidates gives each its own field (between separators) as raw, and the text before it there as neighbour.
    """
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    rows = docs.select("doc_id", F.col(path).cast("string").alias("path"), F.explode(F.array(words)).alias("w"))
    at = F.filter(F.transform("w", lambda x, i: F.when(F.length(x) >= LEAST, i)), lambda i: i.isNotNull())
    rows = rows.select("*", F.explode(F.array(at)).alias("at")).where(F.size("at") > 0)
    w = F.col("w")
    one = lambda i: F.struct((i + 1).alias("word_no"), F.get(w, i).alias("raw"), F.get(w, i - 1).alias("before"), F.get(w, i - 2).alias("before2"), F.get(w, i + 1).alias("after"))
    rows = rows.select("doc_id", "path", F.explode(F.transform("at", one)).alias("c")).select("doc_id", "path", "c.*")
    marked = F.regexp_replace(F.translate("raw", "\x01\x02", "\x03\x03"), RUN, "\x01$0\x02")
    rows = rows.select("*", F.explode(F.array(F.split(marked, "\x01"))).alias("p"))
    cand, tail = (lambda x: F.substring_index(x, "\x02", 1)), (lambda x: F.substring_index(x, "\x02", -1))
    rows = rows.select("*", F.explode(F.transform("p", lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.translate(F.get("p", i - 1), "\x02", "").alias("y")))).alias("q")).where("q.i > 0")
    rows = rows.select("*", (F.size("p") > 2).alias("several"), cand(F.col("q.x")).alias("cand"), F.regexp_extract("q.y", f"[^{PARTS}]*$", 0).alias("own"), F.regexp_extract(tail(F.col("q.x")), f"^[^{PARTS}]*", 0).alias("rest"))
    named, last = F.col("several") & F.col("own").rlike("[A-Za-z0-9]"), F.col("q.i") == F.size("p") - 1
    return rows.select(
        "doc_id", "path", "word_no", F.when(F.col("several"), F.concat("own", "cand", "rest")).otherwise(F.col("raw")).alias("raw"),
        F.when(named, F.rtrim(F.col("own"), F.lit("\"'`"))).otherwise(F.col("before")).alias("before"),
        F.when(~named, F.col("before2")).when(F.col("q.i") == 1, F.col("before")).alias("before2"), F.when(last, F.col("after")).alias("after"), "cand",
    )


def example_findings(spark: SparkSession, n: int = 6000, words: list[str] | None = None) -> DataFrame:
    """Labelled findings (cand, raw, before, before2, after, path, label) made by rule: keys in assignments and configuration, against
    identifiers and run-together phrases of `words`, numbers, host names, commit and check sums, identifiers, placeholders and keys in test paths."""
    r = lambda salt, m: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(m)).cast("int")
    pick = lambda salt, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), r(salt, len(xs)) + 1)
    digest = F.sha2(F.col("id").cast("string"), 512)
    mixed = F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", "")
    words = words or PLAIN
    listed, sign = literal(words, "array<string>"), pick(21, "", "_", "-", ".", "")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.get(listed, F.pmod(F.xxhash64(F.col("id"), i), F.lit(len(words))).cast("int")))
    prose = F.array_join(F.when(r(22, 3) == 0, F.transform(drawn, F.initcap)).otherwise(drawn), "\x01")
    prose = F.replace(prose, F.lit("\x01"), sign)
    numbers = F.regexp_replace(F.concat(F.conv(F.substring(digest, 1, 14), 16, 10), F.conv(F.substring(digest, 15, 14), 16, 10)), "[^0-9]", "")
    key = F.when(r(1, 4) == 0, F.substring(mixed, 1, 20 + 8 * r(2, 4))).when(r(1, 4) == 1, F.concat(pick(3, "sk_live_", "ghp_", "AKIA", "xoxb-"), F.substring(mixed, 1, 24))).otherwise(F.substring(digest, 1, 32 + 8 * r(2, 3)))
    kind = r(0, 10)
    cand = F.when(kind < 4, key).when(kind == 4, F.substring(prose, 1, LEAST + r(4, 14))).when(kind == 5, F.substring(numbers, 1, LEAST + r(4, 6)))
    cand = cand.when(kind == 6, F.concat(pick(5, "mail", "www.", "user."), r(6, 90).cast("string"), F.lit(".example."), pick(7, "com", "org", "net"), pick(8, "/index", "/page/12", "-data.test")))
    cand = cand.when(kind == 7, F.substring(digest, 1, 40)).when(kind == 8, F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 12)))
    cand = cand.otherwise(pick(9, "xxxxxxxxxxxxxxxxxxxxxxxx", "EXAMPLEKEYEXAMPLEKEY", "your-token-goes-here-now", "0000000000000000000000"))
    plain = pick(10, "the", "of", "and", "was", "die", "que", "les", ".", "with")
    own = kind < 4
    before2 = F.when(own | ((kind == 9) & (r(11, 2) == 0)), pick(12, "token", "secret", "password", "api_key", "access_key", "Authorization", "PRIVATE_KEY")).when(kind == 7, pick(13, "commit", "sha1", "checksum", "etag")).when(kind == 8, pick(14, "uuid", "guid", "id")).otherwise(plain)
    before = F.when(own | (kind >= 7), pick(15, "=", ":", ":=", "is")).otherwise(pick(16, "the", "a", "to", "und", "de", "="))
    quote = pick(17, '"', "'", "")
    path = F.when((kind == 9) | ((kind < 4) & (r(18, 12) == 0)), pick(19, "tests/fixtures/a.json", "docs/example.md")).otherwise(pick(20, "src/app.py", "config/prod.yml", "src3", "web"))
    label = F.when(own & ~path.rlike(TESTPATH), 1).otherwise(0)
    return spark.range(n).select(cand.alias("cand"), F.concat(quote, cand, quote).alias("raw"), before.alias("before"), before2.alias("before2"), plain.alias("after"), path.alias("path"), label.alias("label")).where(F.length("cand") >= LEAST)


@dataclass
class Forest:
    depth: int
    feature: list[list[int]]  # for each tree, of 2^depth - 1 nodes
    limit: list[list[int]]  # larger bins go right
    leaf: list[list[float]]
    corpus: Corpus = NOTHING


def literal(value: list, kind: str) -> Column:
    """A nested constant; the optimizer folds the parsing."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def node_of(tree: Column, bins: Column, levels: int) -> Column:
    """Number of the node that a row reaches after so many levels (children of n: 2n+1, 2n+2)."""
    step = lambda n, _: n * 2 + 1 + (F.get(bins, F.get(tree["f"], n)) > F.get(tree["c"], n)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), step) if levels else F.lit(0)


def grown(findings: DataFrame, corpus: Corpus = NOTHING, trees: int = 15, depth: int = 5, chosen: int = 4, rows: int = 50_000) -> Forest:
    """Grow a forest from labelled findings (those with the least hash, at most `rows`), seen through what was learned from a corpus."""
    bins = with_coverage(findings, corpus).select(features(corpus).alias("x"), F.col("label").cast("int").alias("y"), F.xxhash64("cand", "before", "before2", "path").alias("h")).orderBy("h").limit(rows)
    uniform = lambda t: F.pmod(F.xxhash64("h", F.lit(t)), F.lit(1_000_003)) / 1_000_003.0
    times = lambda u: (u > 0.3679).cast("int") + (u > 0.7358).cast("int") + (u > 0.9197).cast("int") + (u > 0.9810).cast("int")
    bins = bins.select("x", "y", F.array(*[times(uniform(t)) for t in range(trees)]).alias("w")).groupBy("x", "y", "w").count().cache()
    inner = (1 << depth) - 1
    forest = Forest(depth, [[0] * inner for _ in range(trees)], [[BINS] * inner for _ in range(trees)], [[0.0] * (inner + 1) for _ in range(trees)], corpus)
    for level in range(depth + 1):
        model = literal([{"t": t, "f": f, "c": c} for t, (f, c) in enumerate(zip(forest.feature, forest.limit, strict=True))], "array<struct<t: int, f: array<int>, c: array<int>>>")
        of = F.transform(model, lambda m: F.struct(m["t"].alias("t"), node_of(m, F.col("x"), level).alias("n"), (F.get(F.col("w"), m["t"]) * F.col("count")).alias("w")))
        per_tree = bins.select("x", "y", F.explode(of).alias("o")).where("o.w > 0")
        if level == depth:
            got = per_tree.groupBy("o.t", "o.n").agg(F.sum(F.col("o.w") * F.col("y")).alias("p"), F.sum("o.w").alias("w")).collect()
            for r in got:
                forest.leaf[r["t"]][r["n"] - inner] = (r["p"] + 0.5) / (r["w"] + 1.0)
            break
        sums = per_tree.select("o.*", "y", F.posexplode("x").alias("f", "b")).groupBy("t", "n", "f", "b").agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum("w").alias("w")).collect()
        by: dict[tuple[int, int], dict[int, list]] = {}
        for r in sums:
            by.setdefault((r["t"], r["n"]), {}).setdefault(r["f"], []).append((r["b"], r["p"], r["w"]))
        for (t, n), table in by.items():
            tried = sorted(table, key=lambda f: zlib.crc32(f"{t},{n},{f}".encode()))[:chosen]
            forest.feature[t][n], forest.limit[t][n] = best_split({f: table[f] for f in tried})
    bins.unpersist()
    return forest


def best_split(table: dict[int, list]) -> tuple[int, int]:
    """Feature and bin with the least weighted Gini impurity; ties to the lower feature and bin; all left if nothing divides."""
    best = (float("inf"), 0, BINS)
    for f, cells in sorted(table.items()):
        cells.sort()
        total, good = sum(c[2] for c in cells), sum(c[1] for c in cells)
        w = p = 0
        for b, cp, cw in cells[:-1]:
            w, p = w + cw, p + cp
            impurity = p * (1 - p / w) + (good - p) * (1 - (good - p) / (total - w))
            best = min(best, (impurity, f, b))
    return best[1], best[2]


def scanned(docs: DataFrame, forest: Forest, path: str = "source", least: float = 0.5) -> DataFrame:
    """doc_id, word_no, length, sha256, masked, score and kept for every candidate of docs (doc_id, text, `path`).

    kept is false for what the forest takes for a false positive. Secrets themselves are not returned. Null texts have no candidates; a
    null path counts as empty; repeated rows and null ids stay; empty tables give no rows; other columns are not read.
    """
    model = literal([{"f": f, "c": c, "l": v} for f, c, v in zip(forest.feature, forest.limit, forest.leaf, strict=True)], "array<struct<f: array<int>, c: array<int>, l: array<double>>>")
    found = written(candidates(docs, path), "secret-candidates")
    rows = with_coverage(found, forest.corpus).select("*", F.explode(F.array(features(forest.corpus))).alias("x"))
    first_leaf = (1 << forest.depth) - 1
    score = F.aggregate(model, F.lit(0.0), lambda s, m: s + F.get(m["l"], node_of(m, F.col("x"), forest.depth) - first_leaf)) / len(forest.leaf)
    return rows.select("doc_id", "word_no", F.length("cand").alias("length"), F.sha2("cand", 256).alias("sha256"), F.concat(F.substring("cand", 1, 4), F.lit("****")).alias("masked"), score.alias("score")).withColumn("kept", F.col("score") >= least)
