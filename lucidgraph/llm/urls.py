"""URL filters: a blocked Bloom filter before an exact join, in DataFrame operations only.

A rule is a host and the start of a path with a verdict.  It fits its host and
all subdomains when the url's path starts with its own; of those that fit, the
longest wins.  The keys of a url (each parent host with each start of the path
that is as long as some rule's) are first tried on a blocked Bloom filter of the
rules: one 256-bit block a key, so that one small row answers.  What passes goes
to an exact join on the key itself, which removes the false positives.

A null url, or one without ``://``, has an empty host and path and no rule.
Ties of length go to the longer host, then to ``allow``.  Each distinct host and
path is judged once; repeated rows give repeated rows.  No rules: all get the
default.  Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import free_name

#: The filter is broadcast; beyond so many blocks (32 bytes each) it gets denser, not larger.
MAX_BLOCKS = 1 << 18
#: Rules that are certainly fewer than this are broadcast in the exact join too.
SMALL_RULES = 100_000
_PROBES = 6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``; path: then up to ``?``, ``#``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(raw, upper, lower), path


def _words(key: Column) -> Column:
    """Four 64-bit words of the block's bits for a key."""
    # probe i sets bit (h >> 8 i) mod 256
    h = F.xxhash64(F.lit("bits"), key)
    bits = [F.shiftright(h, 8 * i).bitwiseAND(F.lit(255)) for i in range(_PROBES)]
    out = []
    for word in range(4):
        mask = F.lit(0).cast("long")
        for bit in bits:
            here = F.floor(bit / 64) == word
            power = F.expr("1L") * F.call_function(
                "shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")
            )
            mask = mask.bitwiseOR(F.when(here, power).otherwise(F.lit(0).cast("long")))
        out.append(mask)
    return F.array(*out)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w3): the bits of all keys, a row for each block that has any."""
    words = keys.select(_block(F.col(key), blocks).alias("block"), _words(F.col(key)).alias("w"))
    return words.groupBy("block").agg(*(F.bit_or(F.col("w")[i]).alias(f"w{i}") for i in range(4)))


def possible(df: DataFrame, key: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter: all that are, few others."""
    keys = df.withColumns({"_block": _block(F.col(key), blocks), "_w": _words(F.col(key))})
    hits = keys.join(F.broadcast(filter_), F.col("_block") == F.col("block"))
    for i in range(4):
        hits = hits.where(F.col(f"w{i}").bitwiseAND(F.col("_w")[i]) == F.col("_w")[i])
    return hits.select(*df.columns)


def judge(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    small_rules: int = SMALL_RULES,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (replaced if there).

    ``rules`` has ``host``, ``path`` and ``verdict``; rows with a null in them are left out.
    """
    rules = (
        rules.select("host", "path", "verdict")
        .dropna()
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
    )
    known = rules.agg(
        F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths")
    ).first()
    host, path = host_and_path(F.col(url).cast("string"))
    hash_name, best_name = free_name(pages, "url_key"), free_name(pages, "best")
    kept = pages.drop("host", "path", "rule", "verdict")
    located = kept.withColumns({"host": host, "path": path})
    located = located.withColumn(hash_name, F.concat_ws("\n", "host", "path"))
    if not known["n"]:
        return located.drop(hash_name).withColumns(
            {"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}
        )
    blocks = 1
    while blocks < min(MAX_BLOCKS, known["n"] / 16):
        blocks *= 2
    listed = rules.select(
        F.concat_ws("\n", "host", "path").alias("key"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_chars"),
        "verdict",
    )
    labels = F.split("host", r"\.", -1)
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    # the lengths of rules' paths are as many at most as a url has characters
    lengths = F.filter(
        F.array(*(F.lit(n) for n in sorted(known["lengths"]))),
        lambda n: n <= F.length("path"),
    )
    distinct = located.where(F.col("host") != "").select(hash_name, "host", "path").distinct()
    keys = distinct.select(
        hash_name, F.explode(parents).alias("parent"), "path", lengths.alias("lengths")
    ).select(hash_name, "parent", "path", F.explode("lengths").alias("length"))
    keys = keys.select(
        hash_name,
        F.concat("parent", F.lit("\n"), F.substring("path", F.lit(1), F.col("length"))).alias("key"),
    )
    hits = possible(keys, "key", bloom(listed, "key", blocks), blocks)
    exact = F.broadcast(listed) if known["n"] < small_rules else listed
    # the longest rule, then the longer host, then the verdict first in the alphabet
    order = F.struct(
        F.length("rule").alias("chars"), "host_chars", (-F.ascii("verdict")).alias("kind")
    )
    best = (
        hits.join(exact, "key")
        .groupBy(hash_name)
        .agg(F.max_by(F.struct("rule", "verdict"), order).alias(best_name))
    )
    judged = located.join(best, hash_name, "left")
    return judged.withColumns(
        {
            "rule": F.col(best_name)["rule"],
            "verdict": F.coalesce(F.col(best_name)["verdict"], F.lit(default)),
        }
    ).drop(hash_name, best_name)
