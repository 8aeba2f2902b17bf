"""Document fingerprints: SimHash in DataFrame operations only.

The terms of a text are its white-space separated words; each votes with a 64-bit hash, its
weight the number of its characters, so long words count for more than the short ones that all
texts share. Bit i is set if the words with that bit carry over half the weight. Votes for bits
i and i + 32 are summed in the two halves of one long, which no text can overflow.

Fingerprints within a radius are found by permuted block tables: the 64 bits are cut into blocks,
every table brings some blocks to the front and sorts fingerprints by them, and two fingerprints
within the radius agree on the front of at least one table. Every pair is verified inside the
join and reported by the first table that can hold it.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one id, or without one, that are put in order together.
MOST_ROWS = 200_000
LANES = 32
_PAIR = (1 << 32) + 1

_VOTES = [f"s{i}" for i in range(LANES)]


def term_votes(rows: DataFrame, keys: list[str], text_col: str, carried: dict[str, str] | None = None) -> DataFrame:
    """`keys`, `carried` (a numeric column each, constant for a key) and `fp` of each key's text.

    Words never leave their task: they are summed up to one row for a key and task before the
    shuffle.
    """
    carried = carried or {}
    words = rows.select(*keys, *carried, F.explode(F.split(F.col(text_col), r"\s+")).alias("word"))
    h, weight = F.xxhash64("word"), F.char_length("word").cast("bigint")
    # `voted` keeps hash and weight apart from the sums, so each is computed once for a word
    voted = words.select(*keys, *carried, h.alias("h"), weight.alias("weight"))
    sums = [
        F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_PAIR)) * F.col("weight")).alias(_VOTES[i])
        for i in range(LANES)
    ]
    total = voted.groupBy(*keys).agg(
        F.sum("weight").alias("total"), *[F.max(c).alias(c) for c in carried], *sums
    )
    return total.select(*keys, *[F.col(c).alias(name) for c, name in carried.items()], _bits(F.col("total")).alias("fp"))


def _bits(total: Column) -> Column:
    bits = []
    for i, name in enumerate(_VOTES):
        low, high = F.col(name).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(name, 32)
        bits += [
            F.when(low * 2 > total, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"),
            F.when(high * 2 > total, F.shiftleft(F.lit(1).cast("bigint"), i + 32)).otherwise(F.lit(0).cast("bigint")),
        ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and `fp` of every distinct (id, text); null, empty and blank texts get 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    return term_votes(rows, ["id", "mark"], "text").select(F.col("id").alias(id_col), "fp")


def _masks(blocks: int) -> list[int]:
    """The bits of each block, as signed longs."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(1 << b for b in range(lo, hi))) for lo, hi in zip(edges, edges[1:], strict=False)]


def neighbours(fps: DataFrame, radius: int = 3, front: int = 3) -> DataFrame:
    """Pairs `fp_a` < `fp_b` of a table of distinct `fp` with at most `radius` differing bits.

    The bits are cut into radius + front blocks; some `front` blocks are then equal, and there
    is a table for every choice of them. More blocks in front mean fewer strangers in a cell and
    more tables. No row is dropped whatever the size of a cell; null fingerprints have no pairs.
    """
    masks = _masks(radius + front)
    tables = []
    for t, chosen in enumerate(combinations(range(len(masks)), front)):
        mask = sum(masks[b] for b in chosen)
        earlier = [masks[b] for b in range(chosen[-1]) if b not in chosen]
        tables.append((t, mask, earlier + [0] * (radius - len(earlier))))
    spec = F.array(
        *[F.struct(F.lit(t).alias("t"), F.lit(m).cast("bigint").alias("m"), F.array(*[F.lit(e).cast("bigint") for e in es]).alias("e")) for t, m, es in tables]
    )
    rows = fps.filter("fp is not null").select("fp", F.explode(spec).alias("s"))
    left = rows.select(
        F.col("s.t").alias("t"), F.col("fp").bitwiseAND(F.col("s.m")).alias("cell"), F.col("fp").alias("fp_a"), F.col("s.e").alias("e")
    )
    right = rows.select(
        F.col("s.t").alias("t_b"), F.col("fp").bitwiseAND(F.col("s.m")).alias("cell_b"), F.col("fp").alias("fp_b")
    )
    x = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    first = reduce(
        lambda a, b: a & b,
        [(F.col("e")[k] == 0) | (x.bitwiseAND(F.col("e")[k]) != 0) for k in range(radius)],
    )
    cell = (F.col("t") == F.col("t_b")) & (F.col("cell") == F.col("cell_b"))
    near = (F.col("fp_a") < F.col("fp_b")) & (F.bit_count(x) <= radius) & first
    return left.join(right, cell & near).select("fp_a", "fp_b")


def _ranges(docs: DataFrame, n: int) -> tuple[list, list[list]]:
    """Bounds that deal ids into about n * n even ranges: n coarse ones, each cut finer."""
    shares = [k / (n * n) for k in range(1, n * n)]
    found = docs.agg(F.percentile_approx("id", shares, 20 * n * n).alias("b")).first()["b"] or []
    return found[n - 1 :: n], [found[k * n : k * n + n - 1] for k in range(n)]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside an edited text: its last half replaced by the start of the next
    document by descending id (after the last: the first).

    Returns `id_col`, `n_chars`, `edited_sha256`, `fp`, `edited_fp`, `next_fp`, one row per row.
    Null texts are empty; rows with one id follow each other by text's hash, then text; rows with a null
    id come last, in the same order; an empty table gives an empty result; other columns are not
    read. Ids are dealt into ranges, rows of one id and those without any by hash inside theirs,
    and each range also gets the first document of the next, so no order over all documents, nor over
    all that share an id, is ever made in one task.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    side = max(2, int((2 * int(spark.conf.get("spark.sql.shuffle.partitions"))) ** 0.5 + 1))
    coarse, fine = _ranges(src, side)
    longs = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values]).cast("array<bigint>")
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.col("id")))
    at = below(longs(coarse)) if coarse else F.lit(0)
    src = src.withColumn("c", F.when(F.col("id").isNull(), -1).otherwise(at))
    cells = F.array(*[longs(f) for f in fine]) if coarse else F.array(longs([]))
    cell = F.when(F.col("c") < 0, -1).otherwise(F.col("c") * side + below(F.get(cells, F.col("c"))))
    src = src.withColumn("mark", F.xxhash64("text")).withColumn("range", cell).drop("c")
    # where a range is too long, the rows of its last id (those of one id are all in one range) or those
    # without an id are cut by the hash that orders them; the rest of the range is part 0
    sizes = src.groupBy("range").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    long = sizes.filter(F.col("n") > MOST_ROWS).select(F.col("range").alias("long"), "last", F.ceil(F.col("n") / MOST_ROWS).alias("parts"))
    src = src.join(F.broadcast(long), F.col("range") == F.col("long"), "left")  # at most a row per range
    at = F.floor((F.col("mark").cast("double") / F.lit(2.0**64) + 0.5) * F.col("parts"))
    own = F.col("parts").isNotNull() & F.col("id").eqNullSafe(F.col("last"))
    part = F.when(own, F.least(at, F.col("parts") - 1) + 1).otherwise(0).cast("bigint")
    src = src.select("id", "text", "mark", F.struct(F.col("range").alias("r"), part.alias("part")).alias("range"))
    # the first document of each range, for the range before it; -1 holds rows without an id
    heads = src.groupBy("range").agg(F.max(F.struct(F.coalesce("id", F.lit(-(1 << 63))), "mark", "text")).alias("h"))
    spec = "order by range desc"
    ghosts = heads.select(
        F.expr(f"coalesce(lag(range) over ({spec}), min(range) over ())").alias("range"), F.col("h.mark").alias("mark"),
        F.col("h.text").alias("text"),
    )
    rows = src.withColumn("ghost", F.lit(False)).unionByName(
        ghosts.select("range", "mark", "text", F.lit(None).cast("bigint").alias("id"), F.lit(True).alias("ghost"))
    )
    order = "partition by range order by ghost, id desc, mark desc, text desc"
    rows = rows.selectExpr(
        "range", "id", "text", "ghost", f"row_number() over ({order}) as rn", f"lead(text) over ({order}) as following"
    ).withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.left("following", half))
    rows = rows.withColumn("edited", F.when(~F.col("ghost"), edited))
    sha = F.sha2("edited", 256)
    parts = {f"sha{k}": F.conv(F.substring(sha, 16 * k + 1, 16), 16, -10).cast("bigint") for k in range(4)}
    both = rows.select(
        "range", "rn", "id", "n_chars", F.col("ghost").cast("int").alias("ghost"), *[c.alias(n) for n, c in parts.items()],
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("v"),
    ).select("*", F.col("v.kind").alias("kind"), F.coalesce("v.t", F.lit("")).alias("t"))
    carried = {c: c for c in ("id", "n_chars", "ghost", *parts)}
    fps = term_votes(both, ["range", "rn", "kind"], "t", carried)
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("fp")))
    wide = fps.groupBy("range", "rn").agg(*[F.max(c).alias(c) for c in carried], pick(0).alias("fp"), pick(1).alias("edited_fp"))
    wide = wide.withColumn("next_fp", F.expr("lead(fp) over (partition by range order by rn)"))
    hexed = F.concat(*[F.lower(F.lpad(F.hex(n), 16, "0")) for n in parts])
    return wide.filter("ghost = 0").select(
        F.col("id").alias(id_col), "n_chars", hexed.alias("edited_sha256"), "fp", "edited_fp", "next_fp"
    )
