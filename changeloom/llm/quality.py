"""Quality rules: document features and host-level verdicts, in DataFrame functions only.

Failures of each rule are summed by domain, each domain's rate is shrunk by a beta prior fitted to all domains,
and the verdict of the domain is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.llm.shared import cut

SPACES = " \t\n\u000b\u000c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50
MOST_DUP_LINES, MOST_SYMBOLS = 30, 10  # percent of the lines, of the characters in words
LEAST_RATE, MAJORITY, MOST_STRENGTH, LEAST_STRENGTH = 0.25, 0.5, 1000.0, 2.0
RULES = ["failed_base", "failed_lines", "failed_symbols"]


def _length_of(text: Column, chars: str) -> Column:
    """How many characters of text are in chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def document_features(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, domain (source; null: ''), the base features and n_lines (lines with a word) of each whole text; a null text has no words. With keep, those columns of docs as the struct `row`."""
    row = ["row"] if keep else []
    d = docs.select(*[F.struct(*keep).alias(r) for r in row], F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("domain"), F.coalesce("text", F.lit("")).alias("t"))
    d = d.select(*row, "doc_id", "domain", "t", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("w"))
    d = d.withColumn("n", F.size("w").cast("long"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = F.col("w")
    windows = F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(1), (F.col("n") - 2).cast("int")), lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i"))))
    d = d.select(*row, "doc_id", "domain", "n", (F.length("t") - _length_of(F.col("t"), SYMBOLS + SPACES) + _length_of(F.col("t"), SYMBOLS)).alias("word_chars"), _length_of(F.col("t"), SYMBOLS).alias("n_symbols"), lines.alias("lines"), F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))).alias("s"))
    s = F.col("s")
    near = lambda x, k: F.try_element_at(s, k)["h"].eqNullSafe(x["h"])
    # a window is found again if its neighbour in hash order equals it; try_element_at counts from 1 and has no element 0, so the first looks at itself below
    twice = F.filter(s, lambda x, k: near(x, k + 2) | ((k > 0) & near(x, F.greatest(k, F.lit(1)))))
    d = d.select(*row, "doc_id", "domain", "n", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.size("lines").alias("n_lines"), F.sort_array(F.transform(twice, lambda x: x["i"])).alias("p"))
    p = F.col("p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.try_element_at(p, k + 2) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    d = d.select(*row, "doc_id", "domain", F.col("n").alias("n_words"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"), F.col("n_dup_lines").cast("long"), F.col("n_lines").cast("long"), covered.cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def failures(features: DataFrame) -> DataFrame:
    """The features with a boolean for each host-level rule: the base rules, many equal lines, many symbols."""
    tests = [F.col("base_failed"), 100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"), 100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")]
    return features.withColumns(dict(zip(RULES, tests, strict=True)))


def host_verdicts(features: DataFrame) -> DataFrame:
    """domain, n, the shrunk rate of each rule (rate_...), rejected.

    For each rule a beta prior is fitted to the counts of all domains by weighted moments, so that a domain of many documents
    tells more than one of few: with n_i documents and p_i the share that fails, m is the share over all, and the correlation
    within domains r = (sum n_i (p_i - m)^2 - m (1 - m) (k - 1)) / (m (1 - m) (N - sum n_i^2 / N - (k - 1))), kept within
    1/1001 and 1/3; the prior has mean m and strength 1 / r - 1. A domain is rejected if its shrunk rate of a rule exceeds
    LEAST_RATE and m plus three standard deviations of the prior, or a majority where those lie above it. The prior alone
    stands for how little a small domain says: there is no least number of documents.
    """
    f = failures(features)
    hosts = cut(f.groupBy("domain").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES]), "hosts")
    totals = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n").cast("double")).alias("q"), *[F.sum(r).alias(r) for r in RULES]).first()  # one row
    n, k, q = totals["n"] or 0, totals["k"], totals["q"] or 0.0
    mean = {r: (totals[r] or 0) / n if n else 0.0 for r in RULES}
    spread = hosts.agg(*[F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - mean[r], F.lit(2))).alias(r) for r in RULES]).first()
    out, rejected = hosts, F.lit(False)
    for r in RULES:
        m, v = mean[r], mean[r] * (1 - mean[r])
        room = v * (n - q / n - (k - 1)) if n else 0.0
        within = ((spread[r] or 0.0) - v * (k - 1)) / room if room > 1e-9 else 0.0
        strength = min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / within - 1)) if within > 0 else MOST_STRENGTH
        sd = (v / (strength + 1)) ** 0.5
        most = max(LEAST_RATE, min(max(MAJORITY, m + sd), m + 3 * sd))
        rate = (F.col(r) + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
        out, rejected = out.withColumn(f"rate_{r.removeprefix('failed_')}", rate), rejected | (rate > most)
    return out.withColumn("rejected", rejected).drop(*RULES)


def judge(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Features with `kept`: false if the document fails its own rules or its domain is rejected.

    Null or empty texts have no words and fail; a null source is the domain ''; repeated rows are judged
    each; an empty table gives an empty result; other columns of docs are ignored, whatever their names, but for
    those in keep, which come back as the struct `row`.
    """
    f = cut(document_features(docs, keep), "features")
    v = host_verdicts(f).withColumnsRenamed({"domain": "d"}).drop("n")
    out = f.join(v, F.col("domain") == F.col("d"), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"), *[c for c in v.columns if c.startswith("rate_")], *["row"] * bool(keep))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS domain, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, domain, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
tri AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM tri),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM w),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n, count(*) AS lines FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT w.doc_id, w.domain, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.lines, 0) AS n_lines,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
e AS (SELECT domain, unnest([1, 2, 3]) AS rule, unnest([base_failed, 100 * n_dup_lines > 30 * n_lines, 100 * n_symbols > 10 * word_chars]) AS bad FROM b),
h AS (SELECT domain, rule, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(bad AS INT)) AS DOUBLE) AS x FROM e GROUP BY domain, rule),
m AS (SELECT rule, sum(n) AS n, count(*) AS k, sum(n * n) AS q, sum(x) / sum(n) AS m, sum(x) / sum(n) * (1 - sum(x) / sum(n)) AS v FROM h GROUP BY rule),
c AS (SELECT m.rule, m.m, m.v, v * (m.n - q / m.n - (k - 1)) AS room, sum(h.n * (x / h.n - m.m) ** 2) - v * (k - 1) AS extra
  FROM m JOIN h USING (rule) GROUP BY m.rule, m.m, m.v, m.n, q, k),
s AS (SELECT rule, m, v, CASE WHEN room > 1e-9 AND extra > 0 THEN least(1000.0, greatest(2.0, room / extra - 1)) ELSE 1000.0 END AS k FROM c),
t AS (SELECT rule, m, k, greatest(0.25, least(greatest(0.5, m + sqrt(v / (k + 1))), m + 3 * sqrt(v / (k + 1)))) AS most FROM s),
x AS (SELECT domain, bool_or((x + m * k) / (n + k) > most) AS rejected FROM h JOIN t USING (rule) GROUP BY domain)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rejected AS kept FROM b JOIN x USING (domain)
"""
