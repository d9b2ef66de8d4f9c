"""Token counts without token ids: pieces are counted once per pre-token.

Texts are cut at the tokenizer's special strings, each of which is one token,
and then into pre-tokens. The distinct pre-tokens of the corpus are counted in
pieces by the tokenizer itself, once each. A document's count is the sum, over
its pre-tokens, of frequency times pieces.

Defined results: a null text counts as empty and has no tokens; rows of equal
or null doc_id are counted on their own text, equal rows each get a row; an
empty table gives an empty result; other columns are ignored.

Scale: the most frequent pre-tokens, HOT of them at most, are broadcast and
summed where the text is read, so no frequent pre-token is ever shuffled. The
others, a small part of all occurrences, go through a join on the pre-token.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_key, whole_text

#: Pre-tokens that are broadcast at most, some 100 bytes each.
HOT = 200_000
#: Texts above this many tokens are over the limit.
TOKEN_LIMIT = 512

#: Fixed value: the tokenizer's own rule for pre-tokens.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d|\x20?\p{L}+|\x20?\p{N}+|\x20?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
#: Cuts at white space alone, where every cut is one of the rule above, too. It
#: serves texts with characters that Java's Unicode tables don't know yet.
SPACED = r"\x20?\P{IsWhite_Space}+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
UNKNOWN = r"\p{Cn}"
SPECIAL = "<|endoftext|>"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _parts(text: Column, special: str) -> Column:
    return F.split(text, f"\\Q{special}\\E", -1)


def pre_tokens(text: Column, special: str = SPECIAL) -> Column:
    """Array of the pre-tokens of ``text``, special strings left out."""
    cut = lambda rule: F.flatten(F.transform(_parts(text, special), lambda p: F.regexp_extract_all(p, F.lit(rule), F.lit(0))))
    return F.when(text.rlike(UNKNOWN), cut(SPACED)).otherwise(cut(PRE_TOKEN))


def piece_counts(docs: DataFrame, path: str, special: str = SPECIAL) -> DataFrame:
    """(piece, freq, n): each distinct pre-token, how often it occurs, its tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            coded = tokenizer.encode_batch_fast(batch["piece"].tolist(), add_special_tokens=False)
            yield batch.assign(n=[len(c) for c in coded])

    distinct = docs.select(F.explode(pre_tokens(whole_text(), special)).alias("piece")).groupBy("piece").agg(F.count("*").alias("freq"))
    return distinct.mapInPandas(count, "piece string, freq long, n long")


def _level() -> Column:
    return F.floor(F.log2("freq") * 16)


def _hot_level(counted: DataFrame, hot: int) -> int:
    """The least level of frequency that, with all above it, holds ``hot`` pieces at
    most; levels are sixteenths of a power of two, so there are few."""
    chosen, total = 1 << 16, 0
    for row in sorted(counted.groupBy(_level().alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        total += row["n"]
        if total > hot:
            break
        chosen = row["level"]
    return chosen


def token_counts(docs: DataFrame, path: str, special: str = SPECIAL, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``."""
    counted = materialize(piece_counts(docs, path, special))
    frequent = materialize(counted.filter(_level() >= _hot_level(counted, hot)))
    known = frequent.select(F.col("piece").alias("p"), F.col("n").alias("known"))
    # The key is taken before the explode: after it, it would be hashed for each pre-token.
    held = docs.select("doc_id", text_key().alias("text_key"), pre_tokens(whole_text(), special).alias("all"))
    occurrences = held.select("doc_id", "text_key", F.explode("all").alias("p"))
    # One row for a document's frequent pre-tokens together, one for each of its others.
    per_doc = (
        occurrences.join(F.broadcast(known), "p", "left")
        .groupBy("doc_id", "text_key", F.when(F.col("known").isNull(), F.col("p")).alias("rare"))
        .agg(F.sum("known").alias("known"), F.count("*").alias("times"))
    )
    done = F.col("rare").isNull()
    # Summed rows have no pre-token to join; each gets a key of its own, which meets nothing.
    key = F.when(done, F.concat_ws(":", F.lit(special), F.col("doc_id").cast("string"), F.col("text_key").cast("string"))).otherwise(F.col("rare"))
    others = counted.join(F.broadcast(frequent.select("piece")), "piece", "left_anti").select("piece", "n")
    sums = (
        per_doc.withColumn("key", key).join(others, F.col("key") == F.col("piece"), "left")
        .groupBy("doc_id", "text_key").agg(F.sum(F.coalesce(F.col("known"), F.col("times") * F.col("n"))).alias("tokens"))
        .select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "tokens")
    )
    specials = (F.size(_parts(whole_text(), special)) - 1).cast("long")
    rows = (
        docs.select("doc_id", text_key().alias("text_key"), F.octet_length(whole_text()).cast("long").alias("n_bytes"), specials.alias("specials"))
        .groupBy("doc_id", "text_key", "n_bytes", "specials").agg(F.count("*").alias("copies"))
    )
    # Equal rows were summed together.
    n_tokens = F.col("specials") + (F.coalesce("tokens", F.lit(0)) / F.col("copies")).cast("long")
    return (
        rows.join(sums, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
        .select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        .drop("copy")
    )


def token_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    return token_counts(docs, path or tokenizer_path()).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


ORACLE_SQL = None
