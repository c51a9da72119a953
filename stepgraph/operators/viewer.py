"""What a viewer asks of a procedure: what is in place, what stands inside what, where labels go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LABEL_STEP, LABEL_TOP = 26, 96
BENCH = (-7.0, 2.8, 6, -5.2, 9.0, 2.6)  # first x, step, parts a row, y, first z, step
# Words in a part's name that give it a shape; the first line that matches counts.
SHAPES = (
    ("bolt", "bolt|screw|stud"),
    ("nut", "nut"),
    ("washer", "circlip|washer|shim"),
    ("ring", "ring|seal|gasket|keeper|collet"),
    ("spring", "spring"),
    ("shaft", "shaft|pin|rod|spindle|journal|dowel"),
    ("wheel", "gear|pulley|wheel|rotor|disc"),
    ("valve", "valve|tappet|lifter"),
    ("plate", "plate|cover|housing|case|block|body|deck|manifold"),
)


def present(installs: DataFrame, steps: DataFrame) -> DataFrame:
    """proc_id, step, n_present: how many parts (proc_id, part, step) are in place once each of steps (proc_id, step) is
    done. Counted by a running sum over steps, so no step's parts are gathered."""
    first = installs.groupBy("proc_id", "part").agg(F.min("step").alias("step"))
    new = first.groupBy("proc_id", "step").agg(F.count("*").alias("k"))
    rows = steps.select("proc_id", "step").distinct().join(new, ["proc_id", "step"], "full")
    total = F.coalesce(F.sum("k").over(W.partitionBy("proc_id").orderBy("step")), F.lit(0))
    return rows.withColumn("n_present", total).join(steps.select("proc_id", "step").distinct(), ["proc_id", "step"], "left_semi").select("proc_id", "step", "n_present")


def inside(seats: DataFrame, shells: DataFrame, cell: float = 100.0) -> DataFrame:
    """scene, shell: shells (scene, shell, x0, x1, y0, y1, z0, z1) that hold an active part's seat (scene, x, y, z), the
    faces included. Shells are dealt to the cells of the first axis that they reach, and joined on scene and cell."""
    within = " AND ".join(f"{a} BETWEEN {a}0 AND {a}1" for a in "xyz")
    reach = F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))
    dealt = shells.where("x0 <= x1").withColumn("cell", F.explode(reach))
    return dealt.join(seats.withColumn("cell", F.floor(F.col("x") / cell)), ["scene", "cell"]).where(within).select("scene", "shell").distinct()


def labels(anchors: DataFrame, height: float) -> DataFrame:
    """scene, id, y of labels at anchors (scene, id, y): in the order of their anchors, each at its anchor or LABEL_STEP
    under the label before it. A running maximum says the same as placing one after another."""
    order = W.partitionBy("scene").orderBy("y", "id")
    at = F.least(F.col("y"), F.lit(height - LABEL_TOP))
    n = F.row_number().over(order) - 1
    ranked = anchors.withColumn("n", n).withColumn("lift", at - LABEL_STEP * F.col("n"))
    most = F.max("lift").over(W.partitionBy("scene").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    return ranked.select("scene", "id", (LABEL_STEP * F.col("n") + F.greatest(F.lit(float(LABEL_TOP)), most)).alias("y"))


def shape(name: Column) -> Column:
    """The plain shape of a part without a model, from its name; 'box' if no word tells."""
    low, found = F.lower(F.coalesce(name, F.lit(""))), None
    for kind, words in SHAPES:
        found = F.when(low.rlike(words), kind) if found is None else found.when(low.rlike(words), kind)
    return found.otherwise("box")


def unmodelled(parts: DataFrame, models: DataFrame, shown: int = 3) -> DataFrame:
    """proc_id, n, names (of the first, by ord) of parts (proc_id, ord, part_id, name) that models (part_id) lacks."""
    lost = parts.join(models.select("part_id").distinct(), "part_id", "left_anti")
    ranked = lost.withColumn("r", F.row_number().over(W.partitionBy("proc_id").orderBy("ord", "part_id")))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= shown, F.struct("r", "name")))), lambda x: x["name"]), ", ")
    return ranked.groupBy("proc_id").agg(F.count("*").alias("n"), first.alias("names"))


def on_bench(parts: DataFrame) -> DataFrame:
    """proc_id, part_id, x, y, z: parts (proc_id, ord, part_id) without a place, laid out in rows in front."""
    x, dx, across, y, z, dz = BENCH
    n = F.row_number().over(W.partitionBy("proc_id").orderBy("ord", "part_id")) - 1
    return parts.withColumn("n", n).select("proc_id", "part_id", (x + F.col("n") % across * dx).alias("x"), F.lit(y).alias("y"), (z + F.floor(F.col("n") / across) * dz).alias("z"))


def percent_box(bbox: Column, size: Column) -> Column:
    """left, top, width, height in per cent of the page of a box (x0, top, x1, bottom)."""
    x0, top, x1, bottom = (F.get(bbox, F.lit(i)) for i in range(4))
    w, h = F.get(size, F.lit(0)), F.get(size, F.lit(1))
    return F.struct((x0 / w * 100).alias("left"), (top / h * 100).alias("top"), ((x1 - x0) / w * 100).alias("width"), ((bottom - top) / h * 100).alias("height"))


def primary(spans: DataFrame) -> DataFrame:
    """proc_id, part_id, page, quote, verified: of a part's spans (proc_id, part_id, ord, page, quote, verified; its own
    first, then its steps') the first verified one, else the first."""
    best = F.min_by(F.struct("page", "quote", "verified"), F.struct((~F.coalesce("verified", F.lit(False))).alias("no"), "ord"))
    return spans.groupBy("proc_id", "part_id").agg(best.alias("s")).select("proc_id", "part_id", "s.*")


def tray(parts: DataFrame, placed: DataFrame) -> DataFrame:
    """part_id, name of parts (part_id, name) that are not among placed (part_id), by name."""
    left = parts.select("part_id", "name").join(placed.select("part_id").distinct(), "part_id", "left_anti")
    return left.orderBy(F.lower("name"), "name", "part_id")


def truncated(text: Column, most: int = 58) -> Column:
    """A longer text's first most - 1 characters, right-trimmed, and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most - 1), r"(?U)\s+$", ""), F.lit("\u2026"))).otherwise(text)


def escaped(text: Column) -> Column:
    out = text
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def step_list(steps: DataFrame) -> DataFrame:
    """proc_id, idx, num, body, tags of steps (proc_id, idx, text, torque_nm, tool, verified, page): a row of a procedure's
    list as a viewer shows it, texts escaped; tags are its torque if it is above 0, its tool, and its page if verified."""
    figure = F.when(F.col("torque_nm") > 0, F.concat(number(F.col("torque_nm")), F.lit(" N\u00b7m")))
    page = F.when(F.col("verified"), F.concat(F.lit("p."), F.col("page").cast("string"))).otherwise("inferred")
    tags = F.filter(F.array(figure, F.when(F.col("tool") != "", escaped(F.col("tool"))), page), lambda t: t.isNotNull())
    return steps.select("proc_id", "idx", F.format_string("%02d", F.col("idx") + 1).alias("num"), escaped(F.col("text")).alias("body"), tags.alias("tags"))


def step_detail(steps: DataFrame, parts: DataFrame) -> DataFrame:
    """proc_id, idx, counter ('3 / 8'), body, tags, warning of each step: tags are the names of the parts that it installs
    (parts: proc_id, part_id, name; a part without one goes by its id) and where it stands in the source."""
    named = steps.select("proc_id", "idx", F.posexplode("installs").alias("at", "part_id")).join(parts.select("proc_id", "part_id", "name").dropDuplicates(["proc_id", "part_id"]), ["proc_id", "part_id"], "left")
    held = named.groupBy("proc_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", escaped(F.coalesce("name", "part_id")).alias("name")))), lambda x: x["name"]).alias("names"))
    place = F.when(F.col("verified"), F.concat(F.lit("verified \u00b7 page "), F.col("page").cast("string"))).otherwise("not found in source")
    own = steps.where("proc_id IS NOT NULL").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("proc_id"))).join(held, ["proc_id", "idx"], "left")
    return own.select("proc_id", "idx", F.concat_ws(" / ", (F.col("idx") + 1).cast("string"), F.col("n").cast("string")).alias("counter"), escaped(F.col("text")).alias("body"), F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array(place)).alias("tags"), escaped(F.col("warning")).alias("warning"))


def number(value: Column) -> Column:
    """A figure without a needless '.0'."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")
