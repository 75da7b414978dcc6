"""Mixing sources to target weights: capped water-filling.

Sizes are tokens of a public tokenizer. A source that can't reach its share
even when repeated the most allowed is clamped there, its missing weight goes to
the others in proportion to theirs, and so on until nobody is over the cap.
Records are then drawn: as many whole copies as the repetitions have, and the
fraction by a seeded hash of the record's id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.shipping import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary splits text before merging, a fixed value of its format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The table of targets is a parameter of the mixture and small by nature; more sources than this are refused.
MOST_SOURCES = 100_000
#: Longer texts are counted in parts of at least so many characters, cut where no token reaches across.
PART_CHARS = 1 << 16


@lru_cache(maxsize=4)
def _encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Between these two characters no token of PATTERN reaches across: before a blank, and where the kind of character changes (an apostrophe may begin a contraction).
_BORDER = regex.compile(r"(?<=\S)(?=[ \t\r\n])|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def _parts(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PART_CHARS:
        border = _BORDER.search(text, start + PART_CHARS)
        if border is None:
            break
        yield text[start : border.start()]
        start = border.start()
    yield text[start:]


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The rows with ``tokens`` in place of the text; 0 for null and empty texts. A column of that name is replaced.

    ``tokenizer`` is a vocabulary file that every executor can read.
    """
    rest = [f for f in docs.schema.fields if f.name not in (text, "tokens")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "tokens long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for b in batches:
            n = [sum(len(encoder.encode_ordinary(p)) for p in _parts(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(n, pa.int64())], [*(f.name for f in rest), "tokens"])

    ship(docs.sparkSession)
    return docs.mapInArrow(count, schema)


@dataclass(frozen=True)
class Share:
    """What a source contributes: its copies per record, and the round in which it was clamped at the cap (0: never)."""

    repeats: float
    round: int

    @property
    def clamped(self) -> bool:
        return self.round > 0


def water_fill(tokens: Mapping[str, int], targets: Mapping[str, tuple[float, float]], size: float) -> dict[str, Share]:
    """Repetitions per source for a mixture of ``size`` tokens.

    ``targets`` has each source's share and cap. A source whose tokens, repeated
    the most allowed, are fewer than its share of the size is clamped in the first
    round; weight that clamped sources can't take goes to the free ones in proportion to
    their shares, which may clamp more of them in the next. When all are clamped,
    the mixture stays smaller than wanted. Sources without tokens are clamped at
    once and give nothing; those without a share take no part.
    """
    room = {s: tokens.get(s, 0) * max(cap, 0.0) for s, (_, cap) in targets.items()}
    free = {s for s, (w, _) in targets.items() if w > 0}
    out = dict.fromkeys(targets, Share(0.0, 0))
    number, left = 0, float(size)
    while free:
        number += 1
        weight = math.fsum(targets[s][0] for s in free)
        over = {s for s in free if left * targets[s][0] / weight > room[s]}
        if not over:
            break
        free -= over
        out |= {s: Share(float(targets[s][1]) if room[s] > 0 else 0.0, number) for s in over}
        left = max(0.0, size - math.fsum(room[s] for s in out if out[s].clamped))
    weight = math.fsum(targets[s][0] for s in free)
    return out | {s: Share(left * targets[s][0] / weight / tokens[s] if tokens.get(s) else 0.0, 0) for s in free}


def unique_targets(targets: DataFrame, source: Column) -> DataFrame:
    """``source``, ``target_share`` (summed over repeated rows), ``max_repeats`` (the least); null sources and shares are left out."""
    rows = targets.select(source.alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("double").alias("max_repeats"))
    return rows.where("source is not null and target_share is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.coalesce(F.min("max_repeats"), F.lit(1.0)).alias("max_repeats"))


def plan(per_source: DataFrame, targets: DataFrame) -> tuple[list[dict], int]:
    """One entry per target source with its tokens, share, cap and repetitions; the corpus's tokens.

    ``per_source`` has ``source`` and ``tokens`` of all documents, a null source
    included: the mixture is as large as the corpus.
    """
    spark = targets.sparkSession
    total = per_source.agg(F.sum("tokens")).first()[0] or 0
    rows = targets.join(per_source.where("source is not null"), "source", "left").limit(MOST_SOURCES + 1).collect()  # bounded by the table of targets
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    tokens = {r["source"]: int(r["tokens"] or 0) for r in rows}
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in rows}
    shares = water_fill(tokens, wanted, float(total))
    return [
        {"source": s, "tokens": tokens[s], "target_share": wanted[s][0], "max_repeats": wanted[s][1], "repeats": shares[s].repeats, "clamped": shares[s].clamped, "round": shares[s].round} for s in sorted(wanted)
    ], int(total)


def as_table(spark, entries: list[dict]) -> DataFrame:
    """The plan as a DataFrame, one row per target source."""
    return spark.createDataFrame([tuple(e.values()) for e in entries], "source string, tokens long, target_share double, max_repeats double, repeats double, clamped boolean, `round` int")


def uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) from the MD5 of the seed and the key, which any SQL engine has too."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def draw(docs: DataFrame, planned: DataFrame, seed: int = 17) -> DataFrame:
    """``doc_id``, ``source``, ``tokens``, ``copies`` of each document that is drawn at least once."""
    u = uniform(seed, F.col("doc_id").cast("string"))
    whole = F.floor("repeats").cast("int")
    rows = docs.select("doc_id", "source", "tokens").join(F.broadcast(planned.select("source", "repeats")), "source")  # at most MOST_SOURCES rows
    return rows.select("doc_id", "source", "tokens", (whole + F.when(u < F.col("repeats") - whole, 1).otherwise(0)).alias("copies")).where("copies > 0")


def short_sources(per_source: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources that the water-filling clamps in its first round: repeated the most allowed, they are smaller than their share of all tokens."""
    return as_table(targets.sparkSession, plan(per_source, targets)[0]).where("`round` = 1").select("source")
