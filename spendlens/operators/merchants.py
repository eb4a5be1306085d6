"""Merchant names from card descriptors, by whole-token aliases and suffix frequency.

A descriptor is a merchant followed by a place, a reference or both (``UBER* TRIP TORONTO ON``,
``BLUE CAFE LYON 00417``). Two things find the merchant:

- aliases: the longest alias that the descriptor's tokens begin with, as whole tokens. The alias
  table is one map from phrase to name, looked up once per phrase length, whatever its size;
- trailing tokens that are no part of a name: reference numbers (tokens with a digit), and tokens
  that follow very many different beginnings of descriptors, as places do. How many beginnings a
  token follows is counted over all descriptors; what a descriptor ends with of such tokens goes,
  the first token stays.

Counts are per distinct descriptor, so a merchant with a third of all rows counts once, and the
join of the names back to the rows splits hot descriptors (``skew.join_back``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.text import utrim
from spendlens.operators.enrich import MERCHANT_ALIASES, MERCHANT_SPLIT_RE, WORD_SPLIT_RE, alias_phrase, alias_words
from spendlens.operators.skew import join_back
from spendlens.session import checkpoint_root

# A token is a trailing one if it follows at least this many different beginnings, and this share
# of all of them: a count alone would make common words of names into places as data grows.
MIN_BEGINNINGS = 10
MIN_SHARE = 0.02
# Suffix tokens up to which they are broadcast.
BROADCAST_TOKENS = 100_000
REFERENCE_RE = "[0-9]"


def tokens(text: Column) -> Column:
    """Upper-cased tokens of a text."""
    return F.filter(F.split(F.upper(text), WORD_SPLIT_RE), lambda w: w != "")


def alias_of(words: Column, aliases: list[tuple[str, str]] | None = None) -> Column:
    """The name of the longest alias that the words (``alias_words``) begin with; null if none."""
    table: dict[str, str] = {}
    for phrase, name in aliases if aliases is not None else MERCHANT_ALIASES:
        table.setdefault(alias_phrase(phrase), name)
    if not table:
        return F.lit(None).cast("string")
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    longest = max(p.count(" ") + 1 for p in table)
    return F.coalesce(*[
        F.when(F.size(words) >= n, F.try_element_at(names, F.array_join(F.slice(words, 1, n), " ")))
        for n in range(longest, 0, -1)
    ])


def suffix_tokens(descriptors: DataFrame, words_col: str = "_w", min_beginnings: int = MIN_BEGINNINGS,
                  min_share: float = MIN_SHARE) -> DataFrame:
    """Tokens that follow many different beginnings: (token, n_beginnings). ``descriptors`` holds
    each descriptor's tokens, in any multiplicity."""
    places = descriptors.select(words_col).distinct().select(
        words_col, F.explode(F.when(F.size(words_col) > 1, F.sequence(F.lit(2), F.size(words_col)))).alias("_i")
    )
    follows = places.select(
        F.element_at(words_col, F.col("_i")).alias("token"),
        F.xxhash64(F.slice(words_col, F.lit(1), F.col("_i") - 1)).alias("_beginning"),
    ).distinct()
    counts = follows.groupBy("token").agg(F.count(F.lit(1)).alias("n_beginnings"))
    total = follows.select(F.countDistinct("_beginning")).scalar()
    enough = F.greatest(F.lit(min_beginnings).cast("double"), total * F.lit(min_share))
    return counts.filter((F.col("n_beginnings") >= enough) & ~F.col("token").rlike(REFERENCE_RE))


def simplify_merchants(df: DataFrame, desc_col: str = "raw_description", id_col: str = "transaction_id",
                       aliases: list[tuple[str, str]] | None = None, min_beginnings: int = MIN_BEGINNINGS,
                       min_share: float = MIN_SHARE) -> DataFrame:
    """``df`` with ``merchant``: null for a null descriptor, \'\' for one without tokens."""
    # Whatever stands behind a separator is no part of the name, but an alias may name it.
    eligible = F.col(desc_col).isNotNull()
    texts = df.filter(eligible).groupBy(desc_col).agg(F.count(F.lit(1)).alias("_n"))
    head = F.split(utrim(F.col(desc_col)), MERCHANT_SPLIT_RE, 2).getItem(0)
    texts = texts.withColumns({"_w": tokens(head), "_alias": alias_of(alias_words(F.col(desc_col)), aliases)})
    checkpoint_root(df.sparkSession)
    suffixes = suffix_tokens(texts, "_w", min_beginnings, min_share).select("token").checkpoint()
    few = suffixes.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    # The last token that is neither a reference nor a suffix ends the name.
    places = texts.select(desc_col, F.posexplode("_w").alias("_i", "token")).filter(~F.col("token").rlike(REFERENCE_RE))
    own = places.join(F.broadcast(suffixes) if few else suffixes.hint("merge"), "token", "left_anti")
    ends = own.groupBy(desc_col).agg((F.max("_i") + 1).alias("_end"))
    named = texts.join(ends, desc_col, "left")
    merchant = F.coalesce("_alias", F.array_join(F.slice("_w", F.lit(1), F.coalesce("_end", F.lit(1))), " "))
    return join_back(df, named.select(desc_col, "_n", merchant.alias("merchant")), [desc_col], "_n", id_col, eligible).drop("_n")
