"""Names and quotes in texts by equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.functions import text as T


def identifier_mentions(lines: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, line_no, name: the lines (key, line_no, line) in which a name of names (name) stands as an identifier, each once."""
    words = lines.select(key, "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z0-9_$]+"), 0))).alias("name"))
    return words.join(names.select("name").distinct(), "name").select(key, "line_no", "name")


def quote_check(quotes: DataFrame, texts: DataFrame, quote_key: str, text_key: str, seed: int = 4) -> DataFrame:
    """quote_key, text_key of each text in which a quote stands but for case and white space.

    Both are compared stripped of leading and trailing marks. The first word of a stripped quote may be the tail of a word of
    the text and its last word the head of one; the `seed` words behind the first are whole words of any text that holds it.
    Quotes (quote_key, text) with so many meet texts (text_key, text) by a hash of them; quotes with a single whole word or
    more meet them by that word, and only quotes of one or two words are compared with every text. Quotes of less than three
    bytes and null texts match nothing; rows that repeat a key match each.
    """
    words = lambda c: F.array_remove(F.split(F.lower(c), r"(?U)\s+"), "")
    q = quotes.select(quote_key, F.col("text").alias("quote"), words(T.stripped_quote(F.col("text"))).alias("w"))
    inner = F.size("w") - 2
    size = F.when(inner >= seed, seed).when(inner >= 1, 1)
    keyed = q.select(quote_key, "quote", size.alias("size"), F.xxhash64(F.slice("w", 2, F.coalesce(size, F.lit(0)))).alias("seed")).where("size is not null")
    t = texts.select(text_key, "text", words(F.col("text")).alias("w"))
    grams = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.xxhash64(F.slice("w", i, k))))
    both = F.array_distinct(F.concat(F.coalesce(grams(seed), F.array().cast("array<bigint>")), F.coalesce(grams(1), F.array().cast("array<bigint>"))))
    maybe = t.select(text_key, F.explode(both).alias("seed")).join(keyed.select("seed", quote_key), "seed").select(text_key, quote_key).distinct()
    seen = maybe.join(texts.select(text_key, "text"), text_key).join(quotes.select(quote_key, F.col("text").alias("quote")), quote_key).where(T.quote_in(F.col("quote"), F.col("text")))
    few = q.where(inner < 1).select(quote_key, "quote").join(texts.select(text_key, "text"), T.quote_in(F.col("quote"), F.col("text")))
    return seen.select(quote_key, text_key).unionByName(few.select(quote_key, text_key)).distinct()
