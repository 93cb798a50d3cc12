"""Matches merged into blocks by their units; confidence, one-to-one choice, file blocks and severity.

Prints carry the unit around them: unit_type, unit_start, unit_end, unit_name, and the innermost loop_start, loop_end,
loop_subtype and method_start, method_end, method_name (null where there is none), and the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark import params as P
from sievemark.functions.scalars import basename
from sievemark.functions.spans import Units
from sievemark.operators import meets as M
from sievemark.sources.stored import stored

#: Prints of an owner that may go with each of them.
WHOLE = 64
UNIT = ("file", "start", "end", "unit_type", "unit_start", "unit_end", "unit_name", "loop_start", "loop_end", "loop_subtype", "method_start", "method_end", "method_name")


def enclosing_unit(start: Column, end: Column, spans: Column, types: tuple[str, ...] | None = None) -> Column:
    """The span that holds lines start to end: by priority, then length and place (within types: no priority).

    spans is an array of structs with type, start, end, name and loop_subtype; null where none holds the lines.
    """
    held = F.filter(spans, lambda s: (s["start"] <= start) & (s["end"] >= end) & (s["type"].isin(*types) if types else F.lit(True)))
    priority = F.create_map(*[F.lit(x) for kv in P.UNIT_PRIORITY.items() for x in kv])
    rank = lambda s: F.lit(0) if types else F.element_at(priority, s["type"])
    order = lambda s: F.struct(rank(s).alias("rank"), (s["end"] - s["start"]).alias("length"), s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["name"].alias("name"), s["loop_subtype"].alias("loop_subtype"))
    return F.array_min(F.transform(held, order))


def with_units(prints: DataFrame, spans: str = "spans") -> DataFrame:
    """prints (with start, end and the file's spans) with the unit columns; narrow."""
    unit = lambda types=None: enclosing_unit(F.col("start"), F.col("end"), F.col(spans), types)
    out = prints.withColumns({"_u": unit(), "_l": unit(("LOOP",)), "_m": unit(("METHOD",))})
    named = {f"{name}_{k}": F.col(f"{c}.{k}") for name, c, ks in (("unit", "_u", ("type", "start", "end", "name")), ("loop", "_l", ("start", "end")), ("method", "_m", ("start", "end", "name"))) for k in ks}
    return out.withColumns(named | {"loop_subtype": F.col("_l.loop_subtype")}).drop("_u", "_l", "_m", spans)


def labelled(files: DataFrame, prints: str = "prints", spans: str = "spans") -> DataFrame:
    """A row for each print of files, with the unit columns of with_units: one sweep over a file's spans, and a search in it for each print.

    files has an array of prints (hash, start, end and others) and one of spans for each file; no print carries the spans along.
    """
    kept = [f for f in files.schema if f.name not in (prints, spans)]
    own = files.schema[prints].dataType.elementType
    units = [("unit_type", "string"), ("unit_start", "int"), ("unit_end", "int"), ("unit_name", "string"), ("loop_start", "int"), ("loop_end", "int"), ("method_start", "int"), ("method_end", "int"), ("method_name", "string"), ("loop_subtype", "string")]
    schema = T.StructType([*kept, *own.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in units]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.column(prints)[i].as_py() or []
                of = Units([(s["type"], s["start"], s["end"], s["name"], s["loop_subtype"]) for s in batch.column(spans)[i].as_py() or []])
                nothing = (None,) * 5
                around = [(of.around(p["start"], p["end"]) or nothing, of.around(p["start"], p["end"], "LOOP") or nothing, of.around(p["start"], p["end"], "METHOD") or nothing) for p in found]
                columns = [[batch.column(f.name)[i].as_py()] * len(found) for f in kept] + [[p[f.name] for p in found] for f in own.fields]
                columns += [[u[k] for u, _, _ in around] for k in range(4)] + [[x[k] for _, x, _ in around] for k in (1, 2)] + [[m[k] for _, _, m in around] for k in (1, 2, 3)] + [[x[4] for _, x, _ in around]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return files.mapInArrow(run, schema)


def compatible(a: Column, b: Column) -> Column:
    """Unit types that may match: equal ones, unknown ones, and those within METHOD, LOOP, IF or METHOD, LOOP, SWITCH."""
    both = lambda *t: a.isin(*t) & b.isin(*t)
    return F.coalesce((a == b) | both("METHOD", "LOOP", "IF") | both("METHOD", "LOOP", "SWITCH"), F.lit(True))


def prose_units(prints: DataFrame) -> DataFrame:
    """prints of prose with unit columns: each PROSE_UNIT_LINES lines stand for a method; null where a print crosses two."""
    first = (F.floor((F.col("start") - 1) / P.PROSE_UNIT_LINES) * P.PROSE_UNIT_LINES + 1).cast("int")
    last = first + P.PROSE_UNIT_LINES - 1
    inside = F.col("end") <= last
    nothing = F.lit(None)
    unit = {f"{u}_{k}": F.when(inside, c) for u in ("unit", "method") for k, c in (("start", first), ("end", last))}
    return prints.withColumns(unit | {"file": F.lit("text"), "unit_type": F.when(inside, F.lit("METHOD")), "unit_name": nothing.cast("string"), "method_name": nothing.cast("string"), "loop_start": nothing.cast("int"), "loop_end": nothing.cast("int"), "loop_subtype": nothing.cast("string")})


def matches(prints: DataFrame, key: str = "doc_id", pairs: DataFrame | None = None, is_ref: str | None = None) -> DataFrame:
    """Every occurrence of a hash in one document with every one in another, where the units may match; none of two references if is_ref names their mark.

    Where pairs (key_a, key_b) are given, only they are looked at: a pair's prints are met by pair and hash, and no other pair is made.
    """
    side = lambda s: prints.select("hash", *[F.col(c).alias(f"{c}_{s}") for c in (key, *UNIT, *([is_ref] if is_ref else []))])
    a, b = side("a"), side("b")
    fits = compatible(F.col("unit_type_a"), F.col("unit_type_b"))
    if pairs is not None:
        return pairs.select(f"{key}_a", f"{key}_b").join(a, f"{key}_a").join(b, [f"{key}_b", "hash"]).where(fits)
    return a.join(b, (a["hash"] == b["hash"]) & (a[f"{key}_a"] < b[f"{key}_b"]) & fits & (~(a[f"{is_ref}_a"] & b[f"{is_ref}_b"]) if is_ref else F.lit(True))).drop(b["hash"], *([f"{is_ref}_a", f"{is_ref}_b"] if is_ref else []))


def _with_reporting_unit(found: DataFrame) -> DataFrame:
    """found with type, from_s and to_s: loops where both sides have one that is not within a method on both, else methods; others go."""
    both = lambda u: F.col(f"{u}_start_a").isNotNull() & F.col(f"{u}_start_b").isNotNull()
    within = lambda s: (F.col(f"method_start_{s}") <= F.col(f"loop_start_{s}")) & (F.col(f"loop_end_{s}") <= F.col(f"method_end_{s}"))
    loop = both("loop") & ~F.coalesce(both("method") & within("a") & within("b"), F.lit(False))
    out = found.withColumn("type", F.when(loop, "LOOP").when(both("method"), "METHOD")).where("type is not null")
    return out.withColumns({f"{n}_{s}": F.when(F.col("type") == "LOOP", F.col(f"loop_{c}_{s}")).otherwise(F.col(f"method_{c}_{s}")) for s in "ab" for n, c in (("from", "start"), ("to", "end"))})


def _lengths(blocks: DataFrame) -> DataFrame:
    out = blocks.withColumns({f"length_{s}": F.col(f"to_{s}") - F.col(f"from_{s}") + 1 for s in "ab"})
    return out.withColumn("density", F.col("hash_count") / F.greatest("length_a", "length_b"))


def absorb_loops(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each loop block within a method block on both sides goes to the first such: its counts are added, its kinds joined."""
    pair = [f"{key}_a", f"{key}_b", "file_a", "file_b"]
    place = ["from_a", "to_a", "from_b", "to_b"]
    loops = blocks.where("type = 'LOOP'")
    # broadcast sides are never assumed; the join is by pair and files
    methods = blocks.where("type = 'METHOD'").select(*pair, *[F.col(c).alias(f"m_{c}") for c in place])
    within = F.expr("m_from_a <= from_a and to_a <= m_to_a and m_from_b <= from_b and to_b <= m_to_b")
    homes = loops.join(methods, pair).where(within).groupBy(*pair, *place).agg(F.min(F.struct("m_from_a", "m_from_b", "m_to_a", "m_to_b")).alias("m"))
    taken = loops.join(homes, [*pair, *place])
    kinds = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    more = taken.groupBy(*pair, *[F.col(f"m.m_{c}").alias(c) for c in place]).agg(F.sum("hash_count").alias("more_hashes"), F.sum("raw_match_count").alias("more_matches"), kinds("kinds_a").alias("more_a"), kinds("kinds_b").alias("more_b"))
    rest = loops.join(homes.select(*pair, *place), [*pair, *place], "left_anti")
    none = F.array().cast("array<string>")
    grown = blocks.where("type = 'METHOD'").join(more, [*pair, *place], "left")
    grown = grown.withColumns({"hash_count": F.col("hash_count") + F.coalesce("more_hashes", F.lit(0)), "raw_match_count": F.col("raw_match_count") + F.coalesce("more_matches", F.lit(0))} | {f"kinds_{s}": F.array_sort(F.array_union(f"kinds_{s}", F.coalesce(f"more_{s}", none))) for s in "ab"})
    return grown.select(blocks.columns).unionByName(rest.select(blocks.columns))


def merged(found: DataFrame, key: str = "doc_id", least_lines: int = P.MIN_BLOCK_LINES) -> DataFrame:
    """Blocks: matches grouped by pair and reporting unit, with distinct hashes, matches, kinds of loops and density; loops absorbed.

    Blocks whose longer side has fewer than least_lines lines go. A block's groups meet by map-side combined aggregates.
    """
    by = [f"{key}_a", f"{key}_b", "file_a", "file_b", "type", "from_a", "to_a", "from_b", "to_b"]
    name = lambda s: F.max(F.when(F.col("type") == "METHOD", F.col(f"method_name_{s}")))
    kinds = lambda s: F.array_sort(F.collect_set(f"loop_subtype_{s}"))  # noqa: E731  four values at most
    out = _with_reporting_unit(found).groupBy(*by).agg(
        F.count_distinct("hash").alias("hash_count"), F.count("*").alias("raw_match_count"), *[x for s in "ab" for x in (name(s).alias(f"name_{s}"), F.max(f"method_name_{s}").alias(f"parent_{s}"), kinds(s).alias(f"kinds_{s}"))]
    )
    out = out.where(F.greatest(F.col("to_a") - F.col("from_a"), F.col("to_b") - F.col("from_b")) + 1 >= least_lines)
    return _lengths(absorb_loops(stored(out, "unit-blocks"), key))  # loops and methods are looked at several times


def prose_blocks(pairs: DataFrame) -> DataFrame:
    """Pairs of prose units (meets.unit_pairs) as merged() gives them: methods without names in one file, no loops."""
    to = {f"to_{s}": F.col(f"from_{s}") + F.lit(P.PROSE_UNIT_LINES - 1) for s in "ab"}
    none = {f"{c}_{s}": F.lit(None).cast("string") for s in "ab" for c in ("name", "parent")} | {f"kinds_{s}": F.array().cast("array<string>") for s in "ab"}
    return _lengths(pairs.withColumns(to | none | {"file_a": F.lit("text"), "file_b": F.lit("text"), "type": F.lit("METHOD")}))


def _name_score() -> Column:
    """How far equal names speak for a block, and different ones against it."""
    same = lambda x: (F.trim(F.lower(f"{x}_a")) == F.trim(F.lower(f"{x}_b"))) & (F.trim(f"{x}_a") != "")
    present = lambda x: (F.coalesce(f"{x}_a", F.lit("")) != "") & (F.coalesce(f"{x}_b", F.lit("")) != "")
    methods = F.when(same("name"), 0.25).when(present("name"), -0.15).otherwise(0.0)
    others = F.when(same("parent"), 0.12).when(present("parent"), -0.25).otherwise(0.0)
    return F.when(basename(F.col("file_a")) != basename(F.col("file_b")), 0.0).when(F.col("type") == "METHOD", methods).otherwise(others)


def strong(blocks: DataFrame) -> DataFrame:
    """Blocks dense enough for their length, with the score by which they are assigned."""
    short, longer = F.least("length_a", "length_b"), F.greatest("length_a", "length_b")
    least = F
    for to, d in P.STRONG_STEPS:
        least = least.when(short <= to, d)
    score = 0.52 * F.col("density") + 0.18 * F.least(F.lit(1.0), F.col("hash_count") / short) + 0.10 * (1 - F.abs(F.col("length_a") - F.col("length_b")) / longer) + 0.08 + _name_score() + 0.005 * F.least(F.col("hash_count"), F.lit(6))
    return blocks.where((F.col("hash_count") >= 1) & (F.col("density") >= least.otherwise(P.STRONG_LAST))).withColumn("score", F.round(score, 6))


def confidence(short: Column, density: Column, hashes: Column) -> Column:
    out = F
    for to, high, medium in P.CONFIDENCE_STEPS:
        enough = (density >= high) & (hashes >= P.SMALL_BLOCK_HASHES if to == P.SMALL_BLOCK_LINES else F.lit(True))
        out = out.when((short <= to) & enough, "HIGH").when((short <= to) & (density >= medium), "MEDIUM").when(short <= to, "LOW")
    high, medium = P.CONFIDENCE_LAST
    return out.when(density >= high, "HIGH").when(density >= medium, "MEDIUM").otherwise("LOW")


def with_confidence(blocks: DataFrame) -> DataFrame:
    """blocks with confidence; HIGH becomes MEDIUM where both sides have loops of different kinds."""
    plain = confidence(F.least("length_a", "length_b"), F.col("density"), F.col("hash_count"))
    differ = (F.size("kinds_a") > 0) & (F.size("kinds_b") > 0) & (F.col("kinds_a") != F.col("kinds_b"))
    return blocks.withColumn("confidence", F.when((plain == "HIGH") & differ, "MEDIUM").otherwise(plain))


def one_to_one(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Greedy one-to-one choice: best scores first, no unit twice, none far below a unit's best.

    The choice is made per pair, file names and type; such a list folds in one row, its length is bounded by the units of two documents.
    """
    by = [f"{key}_a", f"{key}_b", "_name_a", "_name_b", "type"]
    unit = lambda s: F.concat_ws("|", f"file_{s}", f"from_{s}", f"to_{s}")
    rows = blocks.withColumns({f"_name_{s}": basename(F.col(f"file_{s}")) for s in "ab"} | {f"_unit_{s}": unit(s) for s in "ab"})
    best = lambda s: F.max("score").over(Window.partitionBy(*by, f"_unit_{s}"))
    near = rows.withColumn("_best_a", best("a")).withColumn("_best_b", best("b")).where((F.col("score") >= F.col("_best_a") - P.ASSIGNMENT_SLACK) & (F.col("score") >= F.col("_best_b") - P.ASSIGNMENT_SLACK))
    row = F.struct((-F.col("score")).alias("o"), (-F.col("hash_count")).alias("h"), F.abs(F.col("length_a") - F.col("length_b")).alias("d"), "from_a", "from_b", "to_a", "to_b", F.col("_unit_a").alias("ua"), F.col("_unit_b").alias("ub"))
    lists = near.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    fold = """aggregate(rows, named_struct('a', cast(array() as array<string>), 'b', cast(array() as array<string>)), (s, x) ->
        if(array_contains(s.a, x.ua) or array_contains(s.b, x.ub), s, named_struct('a', array_append(s.a, x.ua), 'b', array_append(s.b, x.ub))))"""
    chosen = lists.select(*by, F.expr(fold).alias("f")).select(*by, F.explode(F.arrays_zip("f.a", "f.b")).alias("u"))
    chosen = chosen.select(*by, F.col("u.a").alias("_unit_a"), F.col("u.b").alias("_unit_b"))
    return rows.join(chosen, [*by, "_unit_a", "_unit_b"], "left_semi").select(blocks.columns)


def _best_first(key: str) -> Window:
    order = [F.desc("score"), F.desc("density"), F.desc("hash_count"), F.desc(F.least("length_a", "length_b")), "file_a", "from_a", "file_b", "from_b"]
    return Window.partitionBy(f"{key}_a", f"{key}_b").orderBy(*order)


def capped(blocks: DataFrame, key: str = "doc_id", most: int = P.MAX_STRONG_BLOCKS) -> DataFrame:
    """The strongest blocks of each pair, so many as a report shows."""
    return blocks.withColumn("place", F.row_number().over(_best_first(key))).where(F.col("place") <= most)


def weak_fallback(blocks: DataFrame, chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    """For pairs of blocks that have none in chosen: the densest ones, of FALLBACK_DENSITY at least, FALLBACK_BLOCKS at most, with their place."""
    pair = [f"{key}_a", f"{key}_b"]
    order = Window.partitionBy(*pair).orderBy(F.desc("density"), F.desc("hash_count"), "file_a", "from_a", "file_b", "from_b")
    weak = blocks.join(chosen.select(*pair).distinct(), pair, "left_anti").where(F.col("density") >= P.FALLBACK_DENSITY)
    return weak.withColumn("place", F.row_number().over(order)).where(F.col("place") <= P.FALLBACK_BLOCKS)


def flagged(scores: DataFrame, chosen: DataFrame, key: str = "doc_id", threshold: float = 0.0) -> DataFrame:
    """Pairs of scores to report: with a strong block, and similar enough or with blocks that speak for themselves."""
    pair = [f"{key}_a", f"{key}_b"]
    of = chosen.groupBy(*pair).agg(F.count("*").alias("n"), F.count_distinct(F.struct("file_a", "file_b")).alias("files"), F.count_if(F.col("type") == "METHOD").alias("methods"), F.bool_or((F.col("density") >= P.LONE_DENSITY) & (F.col("hash_count") >= P.SMALL_BLOCK_HASHES)).alias("dense"))
    good = (F.col("similarity") >= threshold) | ((F.col("n") >= 2) & (F.col("files") >= 2)) | (F.col("methods") >= 2) | F.col("dense")
    return scores.join(of, pair).where(good).select(scores.columns)


def file_similarity(prints: DataFrame, pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per pair of pairs (key_a, key_b) and file of its first side that has a namesake on the second: plain Jaccard of the hashes, three decimals.

    Of several files of that name on the second side the first by path counts, whether it shares a hash or not.
    """
    sets = prints.select(key, "file", "hash").distinct()
    sizes = sets.groupBy(key, "file").agg(F.count("*").alias("size")).withColumn("name", basename(F.col("file")))
    first = sizes.groupBy(key, "name").agg(F.min(F.struct("file", "size")).alias("f"))
    of_a = sizes.select(F.col(key).alias(f"{key}_a"), "name", F.col("file").alias("file_a"), F.col("size").alias("size_a"))
    of_b = first.select(F.col(key).alias(f"{key}_b"), "name", F.col("f.file").alias("file_b"), F.col("f.size").alias("size_b"))
    met = pairs.select(f"{key}_a", f"{key}_b").join(of_a, f"{key}_a").join(of_b, [f"{key}_b", "name"]).drop("name")
    side = lambda s: sets.select(F.col(key).alias(f"{key}_{s}"), F.col("file").alias(f"file_{s}"), "hash")
    files = [f"{key}_a", "file_a", f"{key}_b", "file_b"]
    shared = met.select(*files).join(side("a"), files[:2]).join(side("b"), [*files[2:], "hash"]).groupBy(*files).agg(F.count("*").alias("shared"))
    both = met.join(shared, files, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    value = F.round(F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")), 3)
    return both.select(f"{key}_a", f"{key}_b", "file_a", "file_b", value.alias("similarity"))


def file_similarity_of_all(prints: DataFrame, key: str = "doc_id", whole: int = WHOLE) -> DataFrame:
    """file_similarity of every pair with a hash in common.

    Where no owner has more than whole prints, each posting of a hash carries its owner's files, and a pair is told at the least
    hash that both have, with all that is asked of it: pairs are not moved. Else pairs are counted in cells and joined with their files.
    """
    sets = stored(prints.select(key, "file", "hash").distinct(), "file-prints")
    if not sets.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > whole).isEmpty():
        return file_similarity(sets, M.cells(key, sets.select(key, "hash").where("hash is not null").distinct(), None, M.shared_hashes, M.SHARED_HASHES), key)
    files = sets.repartition(key).groupBy(key, "file").agg(F.count("*").alias("size"), F.collect_list("hash").alias("hashes")).withColumn("name", basename(F.col("file")))
    owners = files.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("file", "name", "size", "hashes"))).alias("files"))  # whole prints at most
    posted = owners.select(key, "files", F.explode(F.array_distinct(F.flatten("files.hashes"))).alias("hash"))
    side = lambda s: posted.select("hash", F.col(key).alias(f"{key}_{s}"), F.col("files").alias(f"files_{s}"))
    every = lambda s: F.flatten(F.col(f"files_{s}.hashes"))
    met = side("a").join(side("b"), "hash").where(F.col(f"{key}_a") < F.col(f"{key}_b")).where(F.array_min(F.array_intersect(every("a"), every("b"))) == F.col("hash"))
    namesake = lambda f: F.get(F.filter("files_b", lambda g: g["name"] == f["name"]), F.lit(0))  # noqa: E731  the first by path
    both = F.transform("files_a", lambda f: F.struct(f.alias("f"), namesake(f).alias("g")))
    told = F.transform(F.filter(both, lambda x: x["g"].isNotNull()), lambda x: F.struct(x["f"]["file"].alias("file_a"), x["g"]["file"].alias("file_b"), (x["f"]["size"] + x["g"]["size"]).alias("sizes"), F.size(F.array_intersect(x["f"]["hashes"], x["g"]["hashes"])).alias("shared")))
    rows = met.select(f"{key}_a", f"{key}_b", F.explode(told).alias("x"))
    return rows.select(f"{key}_a", f"{key}_b", "x.file_a", "x.file_b", F.round(F.col("x.shared") / (F.col("x.sizes") - F.col("x.shared")), 3).alias("similarity"))


def file_blocks(similar: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """A block over each pair of files that are nearly the same: lines 1 to the last that matches in files of that name."""
    by = [f"{key}_a", f"{key}_b", "file_a", "file_b"]
    name, pair = basename(F.col("file_a")), [f"{key}_a", f"{key}_b", "_name"]
    last = found.where(name == basename(F.col("file_b"))).groupBy(*pair[:2], name.alias("_name")).agg(F.max("end_a").alias("to_a"), F.max("end_b").alias("to_b"))
    near = similar.where(F.col("similarity") >= P.SAME_FILE).withColumn("_name", name).join(last, pair, "left")
    one = lambda c: F.coalesce(c, F.lit(1)).cast("int")
    return near.select(*by, F.lit("FILE").alias("type"), F.lit(1).alias("from_a"), one("to_a").alias("to_a"), F.lit(1).alias("from_b"), one("to_b").alias("to_b"), F.col("similarity").alias("density"), F.lit("HIGH").alias("confidence"))


def report_blocks(chosen: DataFrame, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """The numbered blocks of each pair's report: file blocks first, then the others in their order, but for those of files told already."""
    pair = [f"{key}_a", f"{key}_b"]
    told = files.select(*pair, basename(F.col("file_a")).alias("_name")).distinct()
    rest = chosen.withColumn("_name", basename(F.col("file_a"))).join(told, [*pair, "_name"], "left_anti")
    shared = [*pair, "file_a", "file_b", "type", "from_a", "to_a", "from_b", "to_b", "density", "confidence"]
    every = files.select(*shared, F.lit(0).alias("_kind"), F.lit(0).alias("place"), *[F.lit(None).cast("string").alias(f"name_{s}") for s in "ab"]).unionByName(rest.select(*shared, F.lit(1).alias("_kind"), "place", "name_a", "name_b"))
    number = F.row_number().over(Window.partitionBy(*pair).orderBy("_kind", "place", "file_a"))
    return every.withColumn("block_id", number).withColumns({f"length_{s}": F.col(f"to_{s}") - F.col(f"from_{s}") + 1 for s in "ab"}).drop("_kind", "place")


def highlights(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per pair and side: a map of files to their blocks' (block_id, start, end, unit_type), in order."""
    pair = [f"{key}_a", f"{key}_b"]
    side = lambda s: blocks.select(*pair, F.col(f"{key}_{s}").alias("owner"), F.col(f"file_{s}").alias("file"), F.struct("block_id", F.col(f"from_{s}").alias("start"), F.col(f"to_{s}").alias("end"), F.col("type").alias("unit_type")).alias("b"))
    rows = side("a").unionByName(side("b")).groupBy(*pair, "owner", "file").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    return rows.groupBy(*pair, "owner").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "blocks")))).alias("files"))


def severity(score: Column, density: Column, high: Column, n: Column) -> Column:
    return 0.45 * score + 0.35 * density + 0.2 * F.when(n == 0, 0.0).otherwise(high / n)


def level(value: Column) -> Column:
    return F.when(value >= P.SEVERITY_HIGH, "HIGH").when(value >= P.SEVERITY_MEDIUM, "MEDIUM").otherwise("LOW")


def pair_summary(blocks: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per pair with blocks: counts, lines, mean density, similarity and severity."""
    pair = [f"{key}_a", f"{key}_b"]
    # whole numbers are summed, so that the mean does not depend on the order
    mean = F.sum((F.col("density") * 1000000).cast("long")) / 1000000 / F.count("*")
    out = blocks.groupBy(*pair).agg(F.count("*").alias("n_blocks"), F.count_if(F.col("confidence") == "HIGH").alias("n_high"), F.sum("length_a").alias("lines_a"), F.sum("length_b").alias("lines_b"), mean.alias("mean"))
    out = out.join(scores.select(*pair, "similarity"), pair)
    return with_severity(out, pair)


def with_severity(out: DataFrame, pair: list[str]) -> DataFrame:
    # a hair above, so that halves go up whatever the binary fraction
    value = F.round(severity(F.col("similarity"), F.col("mean"), F.col("n_high"), F.col("n_blocks")) + 1e-9, 4)
    return out.select(*pair, "n_blocks", "n_high", "lines_a", "lines_b", F.round(F.col("mean") + 1e-9, 3).alias("avg_density"), "similarity", value.alias("severity_score"), level(value).alias("severity"))


def prose_summary(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """pair_summary of pairs with similarity and the hash_counts of their blocks of prose."""
    length = F.lit(P.PROSE_UNIT_LINES)
    high = lambda h: confidence(length, h / length, h) == "HIGH"
    whole = F.aggregate(F.transform("hash_counts", lambda h: (h / length * 1000000).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    n = F.size("hash_counts").cast("long")
    out = pairs.withColumns({"n_blocks": n, "n_high": F.size(F.filter("hash_counts", high)).cast("long"), "lines_a": n * length, "lines_b": n * length, "mean": whole / 1000000 / n})
    return with_severity(out, [f"{key}_a", f"{key}_b"])
