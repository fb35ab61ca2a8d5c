"""Text point lists, header hints and raw point attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vec
from ..session import cut_lineage

COMMENT = r"^\s*(#|//|;)"


def read_point_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """XYZ/PTS/ASC/CSV point lists under ``path``: (points, report per file).

    Files may be large: lines are read in splits and every decision that concerns a whole file (its column count, its
    colour range) is an aggregate joined back. The numbers are read from the text once and written.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)).alias("line_no"), "value")
    return parse_point_lines(lines)


def parse_point_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points from text lines (``source, line_no, value``). Column layout follows the width of the data rows: 3 xyz,
    4 + intensity, 6 + rgb, 7 intensity + rgb, 9 rgb + normal; any other width keeps xyz only.

    The first data row sets a file's width. Rows of another width and rows without three numbers give no point; the report counts them
    (``dropped``), and ``status`` is "ok", "ragged" or, for a file without a single point, "unreadable".
    """
    # each step takes up the one before in a projection, never in a filter, which would be moved below and read the text again
    text = lines.select("source", "line_no", "value").withColumns({"_skip": (F.trim("value") == "") | F.col("value").rlike(COMMENT), "_text": F.trim(F.regexp_replace("value", r"[,\s]+", " "))})
    parts = text.select("source", "line_no", "_skip", F.split("_text", " ").alias("_parts"))
    read = cut_lineage(parts.select("source", "line_no", "_skip", F.size("_parts").alias("width"), *[F.get("_parts", F.lit(i)).try_cast("double").alias(f"_n{i}") for i in range(9)]))
    data = read.where(~F.col("_skip")).drop("_skip")
    row = (F.col("width") > 1) & F.col("_n0").isNotNull()
    xyz = row & (F.col("width") >= 3) & F.col("_n1").isNotNull() & F.col("_n2").isNotNull()
    colour = {6: 3, 7: 4, 9: 3}

    def channel(i: int) -> Column:
        at = F.lit(None).cast("double")
        for w, start in colour.items():
            at = F.when(F.col("width") == w, F.col(f"_n{start + i}")).otherwise(at)
        return at

    # what rows of each width hold, from which a file takes that of its first row
    widths = data.groupBy("source", "width").agg(
        F.min(F.when(row, F.col("line_no"))).alias("_first"), F.count(F.when(row, 1)).alias("_all"), F.count(F.when(xyz, 1)).alias("rows"),
        F.count(F.when(~F.coalesce(row, F.lit(False)), 1)).alias("headers"), F.max(F.when(xyz, F.greatest(*[F.abs(channel(i)) for i in range(3)]))).alias("peak"),
    )
    own = F.min(F.when(F.col("_first").isNotNull(), F.struct("_first", "width", "rows", "peak"))).alias("_own")
    files = cut_lineage(widths.groupBy("source").agg(own, F.sum("_all").alias("_all"), F.sum("headers").alias("headers")).where(F.col("_own").isNotNull()).select(
        "source", F.col("_own.width").alias("columns"), F.col("_own.rows").alias("rows"), F.col("_own.peak").alias("peak"), "_all", "headers"
    ))
    rows = data.where(xyz).join(files.select("source", F.col("columns").alias("width"), "peak"), ["source", "width"])
    gain = F.when(F.col("peak") <= 1.0 + 1e-6, 255.0).otherwise(1.0)
    points = rows.select(
        "source", "line_no", *[F.col(f"_n{i}").alias(a) for i, a in enumerate("xyz")],
        *[vec.clip(F.floor(channel(i) * gain), 0, 255).cast("int").alias(c) for i, c in enumerate("rgb")],
        *[F.when(F.col("width") == 9, F.col(f"_n{6 + i}")).alias(f"n{a}") for i, a in enumerate("xyz")],
    )
    report = files.select(
        "source", F.col("columns").cast("long").alias("columns"), "rows", (F.coalesce("peak", F.lit(9.0)) <= 1.0 + 1e-6).alias("scaled_colours"), "headers",
        (~F.col("columns").isin(3, 4, 6, 7, 9)).alias("extra_columns"), (F.col("_all") - F.col("rows")).alias("dropped"),
        F.when(F.col("rows") == 0, "unreadable").when(F.col("rows") < F.col("_all"), "ragged").otherwise("ok").alias("status"),
    )
    return points, report


def software_of(text: Column) -> Column:
    """Name of the capture app a header line mentions, by the first pattern that matches, with its order."""
    out = F.lit(None).cast("struct<o:int,name:string>")
    for i, (name, pattern) in reversed(list(enumerate(K.SOFTWARE_PATTERNS))):
        out = F.when(text.rlike(f"(?i){pattern}"), F.struct(F.lit(i).alias("o"), F.lit(name).alias("name"))).otherwise(out)
    return out


def unit_of(line: Column) -> Column:
    """Unit a line declares, read off its words and what stands between them.

    A full name counts anywhere. A short one counts where something leads up to it (a colon or an equals sign in the gap before, or
    one of the leading words just before) and nothing goes on after it: the line ends, or the gap behind has more than spaces.
    """
    words = F.transform(F.regexp_extract_all(line, F.lit("([A-Za-z]+)"), F.lit(1)), F.lower)
    gaps = F.split(line, "[A-Za-z]+")
    read = F.transform(
        words,
        lambda w, i: F.struct(
            w.alias("word"), F.get(words, i - 1).alias("lead"), F.get(gaps, i - 1).alias("far"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"), (i == F.size(words) - 1).alias("last")
        ),
    )

    def apart(before: Column, after: Column) -> Column:
        """Neither a digit nor an underscore touches the word."""
        return ~before.rlike("[0-9_]$") & ~after.rlike("^[0-9_]")

    def value(r: Column) -> Column:
        sign = r["before"].rlike("[:=][^\\n]{0,%d}$" % K.UNIT_REACH)
        close = (F.length(r["before"]) <= K.UNIT_REACH) & ~r["before"].contains("\n")
        led = F.coalesce(r["lead"].isin(*K.UNIT_LEADS) & close & apart(r["far"], r["before"]), F.lit(False))
        ends = ~r["after"].rlike("^[0-9_]") & (r["last"] | r["after"].rlike("\\S"))
        return (sign | led) & ends

    def full_name(names: list[str]):
        return lambda r: r["word"].isin(*names) & apart(r["before"], r["after"])

    def short_name(unit: str):
        return lambda r: (r["word"] == unit) & value(r)

    named = [F.when(F.exists(read, full_name(names)), u) for u, names in K.UNIT_NAMES.items()]
    short = [F.when(F.exists(read, short_name(u)), u) for u in K.UNIT_SHORT]
    return F.coalesce(*named, *short)


def scan_header_hints(lines: DataFrame, keys: list[str]) -> DataFrame:
    """App and declared unit per scan from its header lines (``keys, line_no, value``).

    The app is the most specific name found anywhere; the unit comes from the first line about units that declares one.
    """
    soft = software_of(F.col("value"))
    unit = F.when(F.col("value").rlike(f"(?i){K.UNIT_CONTEXT}"), unit_of(F.col("value")))
    rows = lines.withColumns({"_s": soft, "_u": unit}).where(F.col("_s").isNotNull() | F.col("_u").isNotNull())
    return rows.groupBy(*keys).agg(
        F.min("_s")["name"].alias("software"), F.min(F.when(F.col("_u").isNotNull(), F.struct("line_no", F.col("_u").alias("u"))))["u"].alias("unit_hint")
    )


def byte_channel(value: Column, peak: Column, is_float: bool) -> Column:
    """A colour channel as 0..255: floats in 0..1 scale up, integers above 255 scale down by the bits their peak needs."""
    if is_float:
        v = F.when(peak <= 1.0 + 1e-6, value * 255.0).otherwise(value)
    else:
        bits = F.length(F.bin(peak.cast("long")))
        v = F.when(peak > 255, value / F.pow(F.lit(2.0), bits - 8)).otherwise(value.cast("double"))
    return vec.clip(F.floor(v), 0, 255).cast("int")


def normalise_colours(points: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), is_float: bool = False) -> DataFrame:
    """All channels of a scan share one observed peak; nothing is assumed from the declared type alone."""
    peak = points.groupBy("scan_id").agg(F.max(F.greatest(*[F.abs(c) for c in channels])).alias("_peak"))
    return points.join(peak, "scan_id").withColumns({c: byte_channel(F.col(c), F.col("_peak"), is_float) for c in channels}).drop("_peak")


def normalise_splats(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splat attributes to plain points: colour from the constant term, unit normals, and the share of faint splats."""
    colour = {c: F.floor(vec.clip(0.5 + K.SPLAT_C0 * F.col(f"f_dc_{i}"), 0.0, 1.0) * 255.0).cast("int") for i, c in enumerate("rgb")}
    out = points.withColumns(colour)
    out = out.withColumn("_l", vec.norm(vec.cols("nx", "ny", "nz")))
    safe = F.when(F.col("_l") < 1e-9, F.lit(1.0)).otherwise(F.col("_l"))
    out = out.withColumns({f"n{a}": F.col(f"n{a}") / safe for a in "xyz"}).withColumn("alpha", 1.0 / (1.0 + F.exp(-F.col("opacity"))))
    report = out.groupBy("scan_id").agg(F.avg((F.col("alpha") < 0.1).cast("double")).alias("faint_fraction"), F.sum((F.col("_l") < 1e-9).cast("long")).alias("zero_normals"))
    return out.drop("_l"), report
