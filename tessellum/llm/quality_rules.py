"""Host-level quality rules with an empirical beta prior, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, WORD, materialize

#: Host-level rules: a row fails each of these by itself; a host is turned down by the shrunk rate of its rows.
RULES = ("base_failed", "symbols_failed", "lines_failed")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row.

    A lambda that names a projected expression has it inlined and evaluated for every
    element; the output of a generator is an attribute, which it is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_repeated_words(df: DataFrame, words: str, out: str, window_hash=F.xxhash64) -> DataFrame:
    """Adds the number of words in 3-word windows that the array ``words`` holds twice or more, the first included.

    The upper bits of each window's hash and its position are sorted as one number, so equal
    windows meet as neighbours (n log n, however repetitive the text). Neighbours of equal
    hash are compared word by word; a text in which two of them differ has its windows
    sorted by their words instead, so no hash decides a count. The positions found are
    swept once for the words that they cover. Null and short arrays have none.
    """
    w, n = F.col(words), F.size(words)
    bits = F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).cast("int")
    starts = F.when(n > 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    parts = lambda i: [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    def neighbours(of: str, key) -> Column:
        def same(x: Column, i: Column) -> Column:
            return F.coalesce(key(F.get(of, i - 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(of, i + 1)) == key(x), F.lit(False))

        return F.filter(of, same)

    packed = F.sort_array(F.transform(starts, lambda i: F.call_function("shiftleft", window_hash(*parts(i)), F.col("_bits")).bitwiseOR(i.cast("long"))))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1
    hashed = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    at = lambda x: x.bitwiseAND(low).cast("int")
    df = once(df, "_bits", bits)
    df = once(df, "_packed", packed)
    df = once(df, "_hits", neighbours("_packed", hashed))

    def differ(i: Column) -> Column:
        a, b = F.get("_hits", i - 1), F.get("_hits", i)
        unequal = [x != y for x, y in zip(parts(at(a)), parts(at(b)), strict=True)]
        return (hashed(a) == hashed(b)) & (unequal[0] | unequal[1] | unequal[2])

    more = F.size("_hits") > 1
    df = once(df, "_clash", F.when(more, F.exists(F.sequence(F.lit(1), F.size("_hits") - 1), differ)).otherwise(F.lit(False)))
    spelled = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *parts(i)).alias("k"), i.alias("i"))))
    df = once(df, "_spelled", F.when(F.col("_clash"), spelled))
    found = F.when(F.col("_clash"), F.transform(neighbours("_spelled", lambda x: x["k"]), lambda x: x["i"])).otherwise(F.transform("_hits", at))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
    swept = F.aggregate(
        F.sort_array(found),
        zero,
        lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(3), x - a["last"]).cast("long")).alias("sum")),
    )
    return df.withColumn(out, F.coalesce(swept["sum"], F.lit(0).cast("long"))).drop("_bits", "_packed", "_hits", "_clash", "_spelled")


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and the rules failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    # every piece that the separators leave is a word, but an empty one at either end
    words = F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    base = once(docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("_t")), "_w", words)
    base = once(base, "_l", lines)
    bare = F.translate("_t", ASCII_SPACE, "")
    counts = base.select(
        "doc_id",
        "host",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
    )
    counts = with_repeated_words(counts, "_w", "n_repeat_words").drop("_w")
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbols_failed": F.col("n_symbols") * 10 > F.col("word_chars"),
            "lines_failed": F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
        }
    )


def host_verdicts(counts: DataFrame, most: float = 0.5) -> DataFrame:
    """(host, n, rate_<rule>..., host_failed): each rule's failures by host, shrunk by a beta prior fitted to all hosts.

    The prior's mean is the failure rate of all rows and its weight comes from the spread
    of the hosts' rates beyond binomial noise (method of moments, between 1 and 1e6 rows).
    A host fails if the shrunk rate of any rule is above ``most``. A null host is one host.
    """
    rates = counts.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    fit = []
    for r in RULES:
        mean = F.sum(r) / F.sum("n")
        fit += [mean.alias(f"m_{r}"), (F.sum(F.col(r) * F.col(r) / F.col("n")) / F.sum("n")).alias(f"s_{r}")]
    prior = rates.agg(*fit, F.sum("n").alias("_all"), F.count("*").alias("_hosts"), F.max("n").alias("top")).withColumn("_one", F.lit(1))
    joined = rates.withColumn("_one", F.lit(1)).join(F.broadcast(prior), "_one")
    out = joined
    for r in RULES:
        m = F.col(f"m_{r}")
        spread = F.col(f"s_{r}") - m * m - m * (1 - m) * F.col("_hosts") / F.col("_all")
        weight = F.when(spread <= 0, F.lit(1e6)).otherwise(F.least(F.lit(1e6), F.greatest(F.lit(1.0), m * (1 - m) / spread - 1)))
        out = out.withColumn(f"rate_{r}", (F.col(r) + m * weight) / (F.col("n") + weight))
    failed = F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > most
    return out.select("host", "n", *[f"rate_{r}" for r in RULES], failed.alias("host_failed"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: float = 0.5) -> DataFrame:
    """Per row: the counts, base_failed, the host's shrunk rates and kept (neither the row nor its host failed).

    Null and empty texts have no words and fail; null hosts form one host. Equal rows get
    equal results. An empty table gives an empty table.
    """
    counts = materialize(rule_counts(docs, id_col, text_col, host_col), "rule-counts")
    hosts = host_verdicts(counts, most).withColumnRenamed("host", "_host")
    joined = counts.join(hosts, counts.host.eqNullSafe(F.col("_host")), "left").drop("_host", "n")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))
