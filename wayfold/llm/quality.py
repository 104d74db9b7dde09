"""Quality by weak supervision, in DataFrame and SQL expressions only.

Rules vote good (1), bad (-1) or abstain (0) on base statistics of a whole text.  The distinct vote
patterns (3^7 at most, whatever the corpus) are counted, expectation maximisation over them
estimates each rule's accuracy on good and on bad documents and the share of good ones, and a
document is kept if the posterior probability that it is good reaches ``THRESHOLD``.

A text's repeated three-word windows are found inside its row from sorted window hashes, so nothing
is exploded or shuffled; the few texts with very many repeats take a sort of (hash, place) instead.

Defined results: a null, empty or blank text has zero statistics and fails the base rules; with no
rows there are no patterns and no output; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: Fixed values of the base: characters of white space (as a trim list and a regular expression) and symbols.
BLANKS, BLANK, SYMBOL = " \t\n\x0b\f\r", "[\\x20\\x09-\\x0D]+", "[#*$%&|<>]"
THRESHOLD, ROUNDS = 0.5, 30
#: Window comparisons in one row above which its repeats are found by sorting.
COMPARISONS = 20_000_000
RULES = ("length", "symbols", "words", "density", "lines", "repeats", "capitals")
#: A word of letters and digits with one closing mark at most.
PLAIN = "^[\\(\"'“]?[\\p{L}\\p{N}'’\\-]+[.,;:!?\\)\"”]?$"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the base counts of whole texts, with those that only the rules use."""
    t = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("trimmed", F.btrim("text", F.lit(BLANKS)))
    words = F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", BLANK))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    t = t.withColumns({"words": words, "lines": lines})
    t = t.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.rlike(w, F.lit(PLAIN)))).cast("long").alias("n_plain"),
        F.length("text").cast("long").alias("n_chars"),
        F.regexp_count("text", F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    many = F.col("n_words") >= 3
    windows = F.expr("slice(zip_with(zip_with(h, slice(h, 2, size(h)), (a, b) -> named_struct('a', a, 'b', b)), slice(h, 3, size(h)), (x, c) -> xxhash64(x.a, x.b, c)), 1, size(h) - 2)")
    t = t.withColumn("g", F.when(many, windows).otherwise(F.array().cast("array<bigint>"))).drop("h")
    t = t.withColumn("s", F.sort_array("g"))
    t = t.withColumn("d", F.expr("array_distinct(array_compact(zip_with(s, slice(s, 2, greatest(size(s), 1)), (x, y) -> if(x = y, x, null))))")).drop("s")
    light = F.expr("array_compact(transform(g, (x, i) -> if(array_contains(d, x), i, null)))")
    placed = "sort_array(transform(g, (x, i) -> named_struct('x', x, 'i', i)))"
    heavy = F.expr(f"sort_array(array_distinct(flatten(array_compact(zip_with({placed}, slice({placed}, 2, greatest(size(g), 1)), (p, q) -> if(p.x = q.x, array(p.i, q.i), null))))))")
    few = F.size("g").cast("long") * F.size("d") <= COMPARISONS
    t = t.withColumn("p", F.when(F.size("d") == 0, F.array().cast("array<int>")).when(few, light).otherwise(heavy)).drop("g", "d")
    repeated = F.expr("aggregate(zip_with(p, slice(p, 2, greatest(size(p), 1)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (n, x) -> n + x)")
    return t.withColumn("n_repeat_words", repeated).drop("p")


def votes(stats: DataFrame) -> DataFrame:
    """``stats`` with the rules' votes as v_<rule>."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))

    def vote(bad, good=F.lit(False)):
        return F.when(F.col("n_words") == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    mean, marks, twice, again = F.col("word_chars") / n, F.col("n_symbols") / n, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n
    plain, dense, capitals = F.col("n_plain") / n, F.col("n_symbols") / F.greatest(F.col("n_chars"), F.lit(1)), F.col("n_capitals") / n
    # what most junk also has (no repeated lines, few capitals) is no sign of quality: those rules abstain
    found = {
        "length": vote((mean < 2) | (mean > 14)),
        "symbols": vote(marks > 0.3, marks < 0.05),
        "words": vote(plain < 0.65, plain > 0.85),
        "density": vote(dense > 0.03),
        "lines": vote(twice > 0.3),
        "repeats": vote(again > 0.3),
        "capitals": vote(capitals > 1),
    }
    return stats.withColumns({f"v_{k}": found[k] for k in RULES})


def accuracies(voted: DataFrame) -> DataFrame:
    """One row: the share of good documents and each rule's accuracy on good and on bad ones, and all patterns."""
    counted = voted.groupBy(*[f"v_{k}" for k in RULES]).count()
    gathered = counted.agg(F.sort_array(F.collect_list(F.struct(F.array(*[f"v_{k}" for k in RULES]).alias("v"), F.col("count").cast("double").alias("n")))).alias("pats"))
    weight = (
        "1 / (1 + exp(-(ln(m.prior / (1 - m.prior)) + aggregate(sequence(0, {last}), 0D, (s, j) -> s + "
        "case p.v[j] when 1 then ln(m.good[j] / (1 - m.bad[j])) when -1 then ln((1 - m.good[j]) / m.bad[j]) else 0D end))))"
    ).format(last=len(RULES) - 1)

    def rate(mass, vote):
        return (
            f"transform(sequence(0, {len(RULES) - 1}), j -> least(0.98D, greatest(0.52D, "
            f"(aggregate(w, 0D, (s, x) -> s + if(x.p.v[j] = {vote}, x.p.n * {mass}, 0D)) + 8D) / "
            f"(aggregate(w, 0D, (s, x) -> s + if(x.p.v[j] != 0, x.p.n * {mass}, 0D)) + 10D))))"
        )

    step = (
        f"element_at(transform(array(transform(pats, p -> named_struct('p', p, 'w', {weight}))), w -> named_struct("
        "'prior', least(0.95D, greatest(0.05D, aggregate(w, 0D, (s, x) -> s + x.p.n * x.w) / aggregate(w, 0D, (s, x) -> s + x.p.n))), "
        f"'good', {rate('x.w', 1)}, 'bad', {rate('(1 - x.w)', -1)})), 1)"
    )
    start = f"named_struct('prior', 0.8D, 'good', array_repeat(0.8D, {len(RULES)}), 'bad', array_repeat(0.8D, {len(RULES)}))"
    model = F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (m, r) -> {step})")
    fitted = gathered.where(F.size("pats") > 0).withColumn("m", model)
    return fitted.withColumn("patterns", F.expr(f"transform(pats, p -> named_struct('v', p.v, 'posterior', {weight}))")).select("m", "patterns")


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, votes, posterior, base_failed and kept of every document."""
    scratch = Scratch(docs.sparkSession, "quality")
    voted = scratch.save(votes(statistics(docs)), "votes")
    posterior = scratch.save(accuracies(voted).select(F.explode("patterns").alias("p")), "posterior")
    posterior = posterior.select(*[F.col("p.v")[i].alias(f"v_{k}") for i, k in enumerate(RULES)], F.col("p.posterior").alias("posterior"))
    # 3^7 patterns at most, so this side is always small
    judged = voted.join(F.broadcast(posterior), [f"v_{k}" for k in RULES], "left")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce("posterior", F.lit(0.0)) >= THRESHOLD))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
