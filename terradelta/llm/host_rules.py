"""Quality rules with host-level verdicts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table, words_of

GRAM = 5
#: The rules that hosts are judged by, as conditions of failure over document_rules' figures. ``base`` also judges each
#: document by itself; the others only tell a host's habits.
RULES = {
    "base": "n_words < 10 OR 100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "words": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}


def document_rules(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, source and the base rules' figures.

    Everything happens inside the row with array functions, so nothing but the figures is ever
    shuffled and one long text is one row's work. Word windows are compared by a chained 64-bit hash
    within one text. Only texts in which some window hash repeats are sorted. Null text: no words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "source", text.alias("text"))
    d = d.withColumn("w", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    d = d.withColumn("lines", lines)
    d = d.select(
        "doc_id", "source", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    gram = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(GRAM)])
    d = d.withColumn("grams", F.when(F.col("n_words") >= GRAM, F.transform(F.sequence(F.lit(0), F.size("w") - GRAM), gram)))
    d = d.drop("w")
    d = d.withColumn("placed", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("at")))))).drop("grams")
    # A window that occurs elsewhere in the text stands beside its twin once windows are sorted.
    before = lambda x, i: (i > 0) & (F.get("placed", F.greatest(i - 1, F.lit(0)))["h"] == x["h"])
    after = lambda x, i: F.coalesce(F.get("placed", i + 1)["h"] == x["h"], F.lit(False))
    twins = F.filter("placed", lambda x, i: before(x, i) | after(x, i))
    d = d.withColumn("starts", F.array_sort(F.transform(twins, lambda x: x["at"]))).drop("placed")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, at: F.struct((at + GRAM).alias("end"), (a["n"] + GRAM - F.greatest(a["end"] - at, F.lit(0))).alias("n"))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate("starts", zero, step)["n"], F.lit(0)).cast("long"))
    failed = [F.expr(rule).alias(f"{name}_failed") for name, rule in RULES.items()]
    return d.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", *failed)


def host_verdicts(rules: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """One row a host: host_docs, its failure rate by each rule (a map), shrunk to the corpus by the rule's own empirical
    beta prior, and the verdict host_kept: no shrunk rate is above ``max_rate``.

    A prior's mean is the corpus rate of its rule; its strength a + b comes from the hosts' rates by the method of
    moments: the spread between hosts beyond what binomial noise explains. Identical hosts give an
    infinitely strong prior (strength capped at 1e6), hosts that differ a weak one. A rule that all hosts keep, or
    none, shrinks nothing away. Failures are counted map-side; all else is on one row a host and rule.
    """
    hosts = rules.groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(f"{r}_failed").alias(r) for r in RULES])
    counts = hosts.select("source", "n", F.expr(f"stack({len(RULES)}, {', '.join(f'{r!r}, {r}' for r in RULES)}) AS (rule, failed)"))
    p = F.col("failed") / F.col("n")
    total = counts.groupBy("rule").agg(F.sum("n").alias("N"), F.sum("failed").alias("bad"), F.sum(F.col("n") * p * p).alias("npp"), F.count("*").alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"))
    mean = F.col("bad") / F.col("N")
    noise = mean * (1 - mean)
    # Between-host variance of rates, weighted by n: E[sum n (p - mean)^2] = noise (k - 1) + var (N - sum n^2 / N).
    spread = F.col("npp") - F.col("N") * mean * mean
    room = F.col("N") - F.col("nn") / F.col("N")
    var = F.when(room > 0, (spread - noise * (F.col("k") - 1)) / room).otherwise(0.0)
    strength = F.when(var > 0, F.least(F.greatest(noise / var - 1, F.lit(1.0)), F.lit(1e6))).otherwise(1e6)
    prior = total.select("rule", mean.alias("prior_rate"), strength.alias("prior_strength"))
    judged = counts.join(F.broadcast(prior), "rule")  # a row a rule: five sums each
    shrunk = (F.col("failed") + F.col("prior_rate") * F.col("prior_strength")) / (F.col("n") + F.col("prior_strength"))
    rates = F.map_from_entries(F.collect_list(F.struct("rule", "rate")))  # an entry a rule
    out = judged.withColumn("rate", shrunk).groupBy("source").agg(F.first("n").alias("host_docs"), rates.alias("host_rates"), F.max("rate").alias("worst"))
    return out.select("source", "host_docs", "host_rates", (F.col("worst") <= max_rate).alias("host_kept"))


def judge(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """document_rules with the verdict ``kept``: false for a document that fails the base rule itself, else whether its
    host (``source``) is kept. Rules are computed once into a stage table; hosts are pre-aggregated
    map-side, and the join back is an equi-join that AQE broadcasts when the hosts prove small and
    splits when one host is hot. Null source: a host of its own. Null or empty text: no words, fails the base rule.
    Null doc_id, repeated rows: rows like others. Empty table: no rows. Only doc_id, source and text are read, so
    other columns may have any name.
    """
    rules = stage_table(document_rules(docs), "rules")
    hosts = host_verdicts(rules, max_rate)
    out = rules.join(hosts, rules["source"].eqNullSafe(hosts["source"]))
    return out.select(*[rules[c] for c in rules.columns if c != "source"], (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host_rates")
