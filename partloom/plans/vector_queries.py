"""Queries over feature vectors, faces and hole candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions import scalars as S
from partloom.functions import vectors as V
from partloom.operators import audit, candidates, cluster, shapes, simjoin, stats
from partloom.session import table

BLOCKS = {"d2_hist": 64, "bbox_ratio": 2, "surf_hist": 6, "dih_hist": 36}


def usable(spark, d, once: bool = True) -> DataFrame:
    """Parts whose four blocks are there, without NaN and not all zero, each once, or with ``once`` False as often as given."""
    s = table(spark, d, "signatures").select("part_id", *BLOCKS)
    good = None
    for c in BLOCKS:
        ok = F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x)) & F.exists(c, lambda x: x != 0)
        good = ok if good is None else good & ok
    return s.filter(good).dropDuplicates(["part_id"]) if once else s.filter(good)


def vec_l2(spark, d):
    """Length of the packed vector and of its unit form."""
    p = usable(spark, d).select("part_id", V.packed(BLOCKS).alias("v"))
    return p.select("part_id", F.size("v").alias("dims"), F.round(V.length(F.col("v")), 6).alias("length"), F.round(V.length(V.unit(F.col("v"))), 6).alias("unit_length"))


def block_norm(spark, d):
    """Block-normed vectors: sum of values and largest value, with blocks weighted equally and by their width."""
    p = usable(spark, d).select("part_id", V.block_normed(BLOCKS).alias("e"), V.block_normed(BLOCKS, "dim_sqrt").alias("w"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    return p.select("part_id", total("e").alias("equal_sum"), F.round(F.array_max("e"), 6).alias("equal_max"), total("w").alias("width_sum"), F.round(F.array_max("w"), 6).alias("width_max"))


def block_dims(spark, d):
    """Width of every block by source, and rows whose block is short of it."""
    s = table(spark, d, "signatures")
    return s.filter(F.col("d2_hist").isNotNull()).groupBy("source_dataset").agg(F.max(F.size("d2_hist")).alias("d2"), F.max(F.size("dih_hist")).alias("dih"), F.count_if(F.size("d2_hist") < 64).alias("short"))


def bbox_spread(spark, d):
    """Largest difference of the bounding-box ratios of each part to those of the smallest part of its geometry hash."""
    u = usable(spark, d).join(table(spark, d, "signatures").select("part_id", "geom_hash").distinct(), "part_id").filter(F.col("geom_hash").isNotNull())
    first = u.groupBy("geom_hash").agg(F.min_by("bbox_ratio", "part_id").alias("ref"))
    return u.join(first, "geom_hash").select("part_id", F.round(V.chebyshev(F.col("bbox_ratio"), F.col("ref")), 6).alias("spread"))


def _queries(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.filter(F.col("vec_id") % 50 == 0), e


def knn_topk(spark, d):
    """The 10 nearest vectors of every vector whose id is divisible by 50."""
    q, e = _queries(spark, d)
    n = simjoin.nearest_of_queries(q, e, "vec_id", "embedding", 10)
    return n.select("query_id", "other_id", F.round("sim", 6).alias("sim"), "rank")


def cosine_pairs(spark, d):
    """Neighbours of the query vectors with a cosine of at least 0.3."""
    return knn_topk(spark, d).filter("sim >= 0.3").select("query_id", "other_id", "sim")


def kth_distance(spark, d):
    q, e = _queries(spark, d)
    n = simjoin.kth_distance(simjoin.nearest_of_queries(q, e, "vec_id", "embedding", 6), 6)
    return n.select("query_id", F.round("dist", 6).alias("dist"))


def auto_eps(spark, d):
    q, e = _queries(spark, d)
    n = simjoin.nearest_of_queries(q, e, "vec_id", "embedding", 6)
    return simjoin.auto_eps(n, 6, 0.12, 1.02).select(F.round("eps", 6).alias("eps"), F.lit(cluster.manual_eps(0.012)).cast("double").alias("fallback"), F.round(F.col("eps") / F.lit(cluster.manual_eps(0.012)), 6).alias("ratio"))


BOX_EPS, BOX_MIN = 0.00497, 6


def _boxes(spark, d) -> DataFrame:
    """Bounding-box ratios as points; ids are row numbers of the part id's hash, so they do not depend on the run."""
    return usable(spark, d).select("part_id", F.xxhash64("part_id").alias("id"), F.col("bbox_ratio")[0].alias("x"), F.col("bbox_ratio")[1].alias("y"))


def eps_neighbours(spark, d):
    """Number of parts whose bounding-box ratios lie within a radius of each part's, itself included."""
    b = _boxes(spark, d)
    return simjoin.degrees_within(b, "part_id", ["x", "y"], BOX_EPS)


def dbscan_core(spark, d):
    """Parts that have enough others within the radius, and those that have not."""
    axes = ["x", "y"]
    core = cluster.grid_core(cluster.grid_points(_boxes(spark, d), axes, BOX_EPS), axes, BOX_EPS, BOX_MIN)
    return core.groupBy("core").agg(F.count("*").alias("n"))


def dbscan_labels(spark, d):
    """Density clusters of the bounding-box ratios, named by their smallest part, and their size; noise under -1."""
    b = _boxes(spark, d)
    labels = cluster.grid_dbscan(b, ["x", "y"], BOX_EPS, BOX_MIN).join(b.select("id", "part_id"), "id")
    name = labels.filter("label <> -1").groupBy("label").agg(F.min("part_id").alias("cluster"))
    return labels.join(name, "label", "left").select("part_id", F.coalesce("cluster", F.lit("-1")).alias("cluster"))


# --- faces and holes -------------------------------------------------------------------------------------------------


def faces(spark, d) -> DataFrame:
    """Order lines as the faces of parts: flag R is a cylinder, A a cone, N a plane."""
    x = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "cylinder").when(F.col("l_returnflag") == "A", "cone").otherwise("plane")
    return x.select(F.col("l_orderkey").alias("part_id"), F.col("l_linenumber").alias("face_no"), kind.alias("kind"), (F.col("l_quantity") / 2).cast("double").alias("radius"), (F.col("l_extendedprice") / 1000).cast("double").alias("depth"), F.col("l_discount").cast("double").alias("ax"), F.col("l_tax").cast("double").alias("ay"), F.lit(0.5).alias("az"), (15 + 5 * F.col("l_linenumber")).cast("double").alias("semi_angle"))


def _points(spark, d) -> DataFrame:
    """Parts as the points of their brand."""
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("part_id"), F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 50).cast("double").alias("y"), (F.col("p_partkey") % 97).cast("double").alias("z"))


def normalised_points(spark, d):
    return shapes.normalised_points(_points(spark, d)).select("part_id", "point_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")])


def pair_distances(spark, d):
    """Histogram of the distances of 20,000 seeded pairs of points per brand."""
    return shapes.pair_distance_histogram(shapes.normalised_points(_points(spark, d)))


def thinned_points(spark, d):
    return shapes.thinned(_points(spark, d), 16).select("part_id", "point_id")


def face_type_hist(spark, d):
    """Share of each kind of surface per part; line numbers stand for the kinds."""
    kind = F.element_at(F.array(*[F.lit(k) for k in shapes.SURFACES]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("part_id"), kind.alias("kind"))
    return shapes.surface_histogram(f).select("part_id", *[F.round(k, 6).alias(k) for k in shapes.SURFACES])


def primitive_kinds(spark, d):
    """Primitives of the hole candidates by kind, and the mean radius."""
    h = table(spark, d, "hole_candidates").dropDuplicates(["hole_id"]).select(F.explode("primitives").alias("p"))
    return h.groupBy("p.kind").agg(F.count("*").alias("n"), F.round(F.avg(F.try_element_at("p.params", F.lit("radius"))), 4).alias("mean_radius"))


def _lines_as_points(spark, d) -> DataFrame:
    """Order lines as points of their supplier."""
    x = table(spark, d, "lineitem")
    return x.select("l_suppkey", F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).cast("double").alias("y"), (F.col("l_discount") * 100).cast("double").alias("z"))


def bbox_ratio(spark, d):
    """Ratios of the sides of the box around each supplier's lines, shortest over longest first."""
    return shapes.box_ratios(_lines_as_points(spark, d), "l_suppkey").select("l_suppkey", F.round("r1", 6).alias("r1"), F.round("r2", 6).alias("r2"))


def hist64(spark, d):
    """Distances of lines from their supplier's mean in 64 equal bins: lines in the bin, and all lines of the supplier."""
    x = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") / 50).cast("double").alias("q"))
    mean = x.groupBy("l_suppkey").agg(F.avg("q").alias("m"))
    bin_ = F.least(F.lit(64), F.width_bucket(F.round(F.abs(F.col("q") - F.col("m")), 9), F.lit(0.0), F.lit(1.0), F.lit(64))).cast("int")
    b = x.join(mean, "l_suppkey").groupBy("l_suppkey", bin_.alias("bin")).agg(F.count("*").alias("n"))
    total = b.groupBy("l_suppkey").agg(F.sum("n").alias("t"))
    return b.join(total, "l_suppkey").select("l_suppkey", "bin", "n", F.col("t").alias("total"))


def roundness(spark, d):
    """How even the distances of a supplier's points from a slanted axis are, and how far they reach along it."""
    points = _lines_as_points(spark, d)
    axes = points.select("l_suppkey").distinct().select("l_suppkey", F.lit(1.2).alias("ax"), F.lit(0.0).alias("ay"), F.lit(1.6).alias("az"), *[F.lit(v).alias(f"o{c}") for c, v in (("x", 5.0), ("y", 2.0), ("z", 0.0))])
    r = shapes.roundness(points, axes, "l_suppkey").join(shapes.extent_along(points, axes, "l_suppkey"), "l_suppkey")
    return r.select("l_suppkey", F.round("roundness", 6).alias("roundness"), F.round("extent", 6).alias("extent"))


def mean_of_means(spark, d):
    """Mean centre of an order over the means of its face kinds, not over its faces; orders without cones have the origin."""
    circles = faces(spark, d).filter(F.col("kind") == "cone").select("part_id", F.col("face_no").alias("no"), (F.col("face_no") % 2).alias("face_no"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z"))
    return shapes.mean_of_centres(circles, faces(spark, d)).select("part_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")])


def coaxial_best_match(spark, d):
    return candidates.best_coaxial(faces(spark, d)).select("part_id", "face_no", "cone_no", F.round("coax_dot", 6).alias("coax_dot"))


def hole_extraction(spark, d):
    return candidates.extract(faces(spark, d), 5.0, 2.0)


def candidates_agg(spark, d):
    """One candidate a part: median diameter, total depth, mean axis, and the mean centre of its cones as the base."""
    f = faces(spark, d)
    centres = shapes.mean_of_centres(f.filter(F.col("kind") == "cone").select("part_id", "face_no", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z")), f)
    c = candidates.one_per_part(f, centres=centres)
    return c.select("part_id", F.round("D0", 6).alias("D0"), F.round("H0", 6).alias("H0"), "alpha0", *[F.round(x, 6).alias(x) for x in ("ax", "ay", "az", "bx", "by", "bz")], "q")


def candidate_quality(spark, d):
    """Quality of the given hole candidates from their coaxiality and entry ring."""
    h = table(spark, d, "hole_candidates").dropDuplicates(["hole_id"])
    return h.select("hole_id", F.round(candidates.quality(F.lit(None).cast("double"), F.nullif(F.col("flags.coax_dot"), F.lit(0.0)), F.col("flags.has_entry_ring")), 6).alias("quality"))


def record_validation(spark, d):
    h = table(spark, d, "hole_candidates").dropDuplicates(["hole_id"])
    return audit.candidate_checks(h).groupBy("problem").agg(F.count("*").alias("n"))


def candidate_totals(spark, d):
    """Candidates per part: mean, median, p90 and largest number, by source."""
    per = table(spark, d, "hole_candidates").select("hole_id", "part_id", "source_dataset").distinct().groupBy("source_dataset", "part_id").agg(F.count("*").alias("n"))
    return per.groupBy("source_dataset").agg(F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("p50"), F.round(F.percentile("n", F.lit(0.9)), 6).alias("p90"), F.max("n").alias("most"))


def capped_sample(spark, d):
    """The first three holes of every part."""
    h = table(spark, d, "hole_candidates").select("hole_id", "part_id").distinct()
    return audit.first_of(h, 3, "part_id", order="hole_id")


def _truth(spark, d) -> tuple[DataFrame, DataFrame]:
    f = faces(spark, d)
    truth = f.filter(F.col("face_no") % 2 == 1).withColumn("gt_id", F.col("face_no")).withColumn("tilt", F.col("semi_angle"))
    return truth, candidates.pair_measures(truth, f.filter(F.col("face_no") % 2 == 0))


def recall_match(spark, d):
    """Odd faces as true holes that an even face of their part matches in axis and depth."""
    truth, pairs = _truth(spark, d)
    return candidates.matched(pairs, 5.73, 8.0, 0.7)


def recall_wilson(spark, d):
    """Recall by kind with its Wilson interval, and weighted by the number of faces of a part."""
    truth, pairs = _truth(spark, d)
    hit = candidates.matched(pairs, 5.73, 8.0, 0.7).withColumn("hit", F.lit(1))
    rows = truth.select("part_id", "gt_id", "kind").join(hit, ["part_id", "gt_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    per = rows.groupBy("kind").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    lo, hi = S.wilson(F.col("hits"), F.col("n"))
    return per.select("kind", "hits", "n", F.round(F.col("hits") / F.col("n"), 6).alias("recall"), F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


def weighted_recall(spark, d):
    """Recall where a part weighs as many as it has true holes, but at least one."""
    truth, pairs = _truth(spark, d)
    hit = candidates.matched(pairs, 5.73, 8.0, 0.7).groupBy("part_id").agg(F.count("*").alias("hits"))
    per = truth.groupBy("part_id").agg(F.count("*").alias("n")).join(hit, "part_id", "left")
    return per.agg(F.count("*").alias("n_parts"), F.round(F.sum(F.coalesce("hits", F.lit(0)) / F.col("n") * F.greatest(F.lit(1), F.col("n"))) / F.sum(F.greatest(F.lit(1), F.col("n"))), 6).alias("recall"))


def _runs(spark, d, truth, pairs) -> DataFrame:
    """A run a part: depths stand for its time, over 200 it times out, and with a single face it errs."""
    f = faces(spark, d)
    hit = candidates.matched(pairs, 5.73, 8.0, 0.7).groupBy("part_id").agg(F.count("*").alias("hits"))
    per = f.groupBy("part_id").agg(F.count_if(F.col("face_no") % 2 == 1).alias("n_true"), F.count_if(F.col("face_no") % 2 == 0).alias("n_found"), F.sum("depth").alias("ms"), F.count("*").alias("n_faces"))
    status = F.when(F.col("n_faces") == 1, "error").when(F.col("ms") > 200, "timeout").otherwise("ok")
    return per.join(hit, "part_id", "left").select("part_id", status.alias("status"), F.coalesce("hits", F.lit(0)).alias("hits"), "n_true", "ms", "n_found")


def stress_evaluation(spark, d):
    """Recall with timeouts, median time and candidates per part of a run over all parts; depths stand for the time."""
    e = candidates.evaluation(_runs(spark, d, *_truth(spark, d)))
    return e.select(F.round("recall", 6).alias("recall"), F.round("median_ms", 4).alias("median_ms"), F.round("per_part", 6).alias("per_part"), "n")


def real_evaluation(spark, d):
    """The same over the hole candidates, where nothing is known to be true: candidates per part and the median depth."""
    h = table(spark, d, "hole_candidates").dropDuplicates(["hole_id"])
    runs = h.groupBy("part_id").agg(F.count("*").alias("n_found"), F.median("H0").alias("ms")).select(F.when(F.col("ms").isNull(), "error").otherwise("ok").alias("status"), F.lit(0).alias("hits"), F.lit(0).alias("n_true"), "ms", "n_found")
    e = candidates.evaluation(runs)
    return e.select(F.round("recall", 6).alias("recall"), F.round("median_ms", 4).alias("median_ms"), F.round("per_part", 6).alias("per_part"), "n")


def tuning_trials(spark, d):
    """Trials of wider axis tolerances, and whether each is accepted against the base setting."""
    truth, pairs = _truth(spark, d)
    grid = candidates.recall_grid(truth, pairs, [5.73, 6.23, 6.73], [0.7])
    per_part = faces(spark, d).groupBy("part_id").agg(F.count_if(F.col("face_no") % 2 == 0).alias("k")).agg(F.avg("k").alias("per_part"))
    trials = grid.join(F.broadcast(per_part)).select(F.col("tol").alias("setting"), "recall", F.lit(0.0).alias("median_ms"), F.round("per_part", 6).alias("per_part"))
    base = trials.filter("setting = 5.73").first().asDict()
    return candidates.accepted(trials, base, 0.05).select("setting", "recall", "per_part", "ok")


def recall_with_centres(spark, d):
    """True holes that a candidate of their part matches in axis, depth and base; the bases are axis components in millimetres."""
    f = faces(spark, d).select("*", *[(F.col(f"a{c}") * 10).alias(f"b{c}") for c in "xyz"])
    truth = f.filter(F.col("face_no") % 2 == 1).withColumn("gt_id", F.col("face_no")).withColumn("tilt", F.col("semi_angle"))
    return candidates.matched(candidates.pair_measures(truth, f.filter(F.col("face_no") % 2 == 0)), 5.73, 8.0, 0.7, centre=(0.01, 0.2))


def report_samples(spark, d):
    """At most 20 rows of negative depth, 200 without a diameter and 200 without any primitive, in order of their id."""
    h = table(spark, d, "hole_candidates").dropDuplicates(["hole_id"])
    kind = F.when(F.col("D0").isNull(), "no_candidate").when(F.col("primitives").isNull() | (F.size("primitives") == 0), "parse_error").when(F.col("H0").isNull() | (F.col("H0") < 0), "error")
    rows = h.select("hole_id", kind.alias("kind")).filter(F.col("kind").isNotNull())
    caps = {"error": 20, "no_candidate": 200, "parse_error": 200}
    return reduce(DataFrame.unionByName, [rows.filter(F.col("kind") == k).orderBy("hole_id").limit(n) for k, n in caps.items()])


def face_probe(spark, d):
    return candidates.probe(faces(spark, d))


def no_candidate_sums(spark, d):
    """Sums of the face counters over the parts without a fitting cylinder."""
    p = candidates.probe(faces(spark, d)).filter("fit = 0")
    return p.agg(F.count("*").alias("n_parts"), *[F.sum(c).alias(c) for c in ("faces", "planes", "cylinders", "cones", "narrow", "shallow", "upright")])


def geom_hash_classes(spark, d):
    """Parts with equal rounded bounding-box ratios and surface histogram: size of each class of at least two."""
    u = usable(spark, d).select("part_id", V.rounded_hash(F.concat("bbox_ratio", "surf_hist"), 2).alias("h"))
    return u.groupBy("h").agg(F.min("part_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("first", "n")


def staged_tuning(spark, d):
    truth, pairs = _truth(spark, d)
    return spark.createDataFrame(candidates.staged(truth, pairs, TOLS, IOUS, 0.7), "stage string, value double, recall double")


def report_pass(spark, d):
    """Whether the chosen setting reaches the target recall."""
    return tuned_setting(spark, d).select("recall", (F.col("recall") >= 0.3).alias("passed"))


TOLS, IOUS = [2.0, 5.73, 12.0], [0.5, 0.7, 0.9]


def param_grid(spark, d):
    truth, pairs = _truth(spark, d)
    return candidates.recall_grid(truth, pairs, TOLS, IOUS)


def tuned_setting(spark, d):
    return candidates.pick(param_grid(spark, d), 0.3)


def stress_set(spark, d):
    """Synthetic hole parameters derived from the part keys."""
    return candidates.stress_holes(table(spark, d, "part").select("p_partkey"), "p_partkey")


def status_counts(spark, d):
    """Events by kind of their error message and type; the message is the event's properties."""
    e = table(spark, d, "events").select("event_type", F.coalesce(S.classify_error(F.col("props").cast("string")), F.lit("none")).alias("error"))
    return e.groupBy("event_type", "error").agg(F.count("*").alias("n"))


def status_rollup(spark, d):
    e = table(spark, d, "events")
    r = e.rollup("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return r.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), "n", "total")


def latency_quantiles(spark, d):
    return stats.describe(table(spark, d, "events"), "value", "event_type").select("event_type", "n", "p50", "p90", "max")


USABLE = "u AS (SELECT DISTINCT ON (part_id) part_id, geom_hash, source_dataset, {0} FROM signatures WHERE {1})".format(
    ", ".join(BLOCKS), " AND ".join(f"{c} IS NOT NULL AND len(list_filter({c}, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter({c}, lambda x: x <> 0)) > 0" for c in BLOCKS)
)
PAD = {c: f"list_resize({c}, {w}, 0.0)" for c, w in BLOCKS.items()}
PACKED = " || ".join(PAD.values())
LEN = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"


def _block_normed(weight: str) -> str:
    each = [f"list_transform({PAD[c]}, lambda x: x / ({LEN.format(PAD[c])} + 1e-12) * {1.0 if weight == 'equal' else w ** -0.5!r})" for c, w in BLOCKS.items()]
    return " || ".join(each)


KNN = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) u FROM e),
  k AS (SELECT a.vec_id query_id, b.vec_id other_id, list_dot_product(a.u, b.u) sim FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, other_id) rank FROM k)"""
BOXES = f"WITH {USABLE}, p AS (SELECT part_id, bbox_ratio[1] x, bbox_ratio[2] y FROM u), g AS (SELECT a.part_id, count(*) AS degree FROM p a JOIN p b ON b.x BETWEEN a.x - {BOX_EPS} AND a.x + {BOX_EPS} AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {BOX_EPS} GROUP BY 1)"
POINTS = """p AS (SELECT p_brand AS part_id, p_partkey AS point_id, p_size::DOUBLE x, p_retailprice::DOUBLE / 50 y, (p_partkey % 97)::DOUBLE z FROM part),
  m AS (SELECT part_id, avg(x) mx, avg(y) my, avg(z) mz, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) + 1e-9 g FROM p GROUP BY 1), n AS (SELECT part_id, point_id, (x - mx) / g AS x, (y - my) / g AS y, (z - mz) / g AS z FROM p JOIN m USING (part_id))"""
FACES = "f AS (SELECT l_orderkey AS part_id, l_linenumber AS face_no, CASE l_returnflag WHEN 'R' THEN 'cylinder' WHEN 'A' THEN 'cone' ELSE 'plane' END AS kind, l_quantity::DOUBLE / 2 AS radius, l_extendedprice::DOUBLE / 1000 AS depth, l_discount::DOUBLE ax, l_tax::DOUBLE ay, 0.5::DOUBLE az, (15 + 5 * l_linenumber)::DOUBLE AS semi_angle FROM lineitem)"
COS = "(a.ax * b.ax + a.ay * b.ay + a.az * b.az) / (sqrt(a.ax * a.ax + a.ay * a.ay + a.az * a.az) * sqrt(b.ax * b.ax + b.ay * b.ay + b.az * b.az))"
COAX = f"x AS (SELECT part_id, face_no, cone_no, coax_dot, semi_angle FROM (SELECT *, row_number() OVER (PARTITION BY part_id, face_no ORDER BY coax_dot DESC, cone_no) r FROM (SELECT a.part_id, a.face_no, b.face_no cone_no, b.semi_angle, round(abs({COS}), 9) coax_dot FROM f a JOIN f b USING (part_id) WHERE a.kind = 'cylinder' AND b.kind = 'cone') WHERE coax_dot > 0.995) WHERE r = 1)"
PAIRS = f"t AS (SELECT * FROM f WHERE face_no % 2 = 1), m AS (SELECT a.part_id, a.face_no AS gt_id, a.semi_angle AS tilt, round(degrees(acos(least(1.0, greatest(-1.0, {COS})))), 6) AS angle, round(least(a.depth, b.depth) / greatest(a.depth, b.depth), 6) AS iou FROM t a JOIN f b USING (part_id) WHERE b.face_no % 2 = 0)"
HIT = "h AS (SELECT DISTINCT part_id, gt_id FROM m WHERE angle <= CASE WHEN tilt <= 45 THEN 5.73 ELSE 8.0 END AND iou >= 0.7)"
GRID = f"g AS (SELECT * FROM (SELECT unnest({TOLS}::DOUBLE[]) AS tol), (SELECT unnest({IOUS}::DOUBLE[]) AS iou_min)), r AS (SELECT tol, iou_min, (SELECT count(DISTINCT (part_id, gt_id)) FROM m WHERE angle <= tol AND iou >= iou_min) AS hits, (SELECT count(*) FROM t) AS n FROM g)"
PROBE = "w AS (SELECT part_id, count(*) AS faces, " + ", ".join(f"count(*) FILTER ({c}) AS {a}" for a, c in (("planes", "kind = 'plane'"), ("cylinders", "kind = 'cylinder'"), ("cones", "kind = 'cone'"), ("narrow", "kind = 'cylinder' AND radius < 2"), ("shallow", "kind = 'cylinder' AND depth < 5"), ("fit", "kind = 'cylinder' AND radius >= 2 AND depth >= 5"), ("upright", "ax = 0 AND ay = 0"))) + " FROM f GROUP BY 1)"
HOLES = "(SELECT DISTINCT ON (hole_id) * FROM hole_candidates)"


def _u(tag: str) -> str:
    return f"(('0x' || md5('{tag}:' || p_partkey)[:8])::BIGINT / 4294967296.0)::DOUBLE"


QUERIES = {
    f.__name__: f
    for f in (
        vec_l2, block_norm, block_dims, bbox_spread, knn_topk, cosine_pairs, kth_distance, auto_eps, eps_neighbours, dbscan_core, dbscan_labels, normalised_points, pair_distances, thinned_points, face_type_hist, primitive_kinds, bbox_ratio,
        hist64, roundness, mean_of_means, coaxial_best_match, hole_extraction, candidates_agg, candidate_quality, record_validation, candidate_totals, capped_sample, recall_match, recall_wilson,
        param_grid, tuned_setting, weighted_recall, face_probe, stress_evaluation, real_evaluation, tuning_trials, recall_with_centres, report_samples, no_candidate_sums, geom_hash_classes, staged_tuning, report_pass, stress_set, status_counts, status_rollup, latency_quantiles,
    )
}

SQL = {
    "vec_l2": f"WITH {USABLE}, p AS (SELECT part_id, {PACKED} v FROM u) SELECT part_id, len(v)::INT AS dims, round({LEN.format('v')}, 6) AS length, round({LEN.format('v')} / ({LEN.format('v')} + 1e-12), 6) AS unit_length FROM p",
    "block_norm": f"WITH {USABLE}, p AS (SELECT part_id, {_block_normed('equal')} e, {_block_normed('w')} w FROM u), q AS (SELECT part_id, e, w, {LEN.format('e')} + 1e-12 le, {LEN.format('w')} + 1e-12 lw FROM p) SELECT part_id, round(list_sum(e) / le, 6) AS equal_sum, round(list_max(e) / le, 6) AS equal_max, round(list_sum(w) / lw, 6) AS width_sum, round(list_max(w) / lw, 6) AS width_max FROM q",
    "block_dims": "SELECT source_dataset, max(len(d2_hist))::INT AS d2, max(len(dih_hist))::INT AS dih, count(*) FILTER (len(d2_hist) < 64) AS short FROM signatures WHERE d2_hist IS NOT NULL GROUP BY 1",
    "bbox_spread": f"WITH {USABLE}, f AS (SELECT geom_hash, arg_min(bbox_ratio, part_id) ref FROM u WHERE geom_hash IS NOT NULL GROUP BY 1) SELECT part_id, round(greatest(abs(bbox_ratio[1] - ref[1]), abs(bbox_ratio[2] - ref[2])), 6) AS spread FROM u JOIN f USING (geom_hash)",
    "knn_topk": f"{KNN} SELECT query_id, other_id, round(sim, 6) AS sim, rank::INT AS rank FROM r WHERE rank <= 10",
    "cosine_pairs": f"{KNN} SELECT query_id, other_id, round(sim, 6) AS sim FROM r WHERE rank <= 10 AND round(sim, 6) >= 0.3",
    "kth_distance": f"{KNN} SELECT query_id, round(sqrt(greatest(0.0, 2 - 2 * sim)), 6) AS dist FROM r WHERE rank = 6",
    "auto_eps": f"{KNN}, z AS (SELECT quantile_cont(sqrt(greatest(0.0, 2 - 2 * sim)), 0.12) * 1.02 e FROM r WHERE rank = 6) SELECT round(e, 6) AS eps, sqrt(0.024) AS fallback, round(e / sqrt(0.024), 6) AS ratio FROM z",
    "eps_neighbours": f"{BOXES} SELECT * FROM g",
    "dbscan_core": f"{BOXES} SELECT degree >= {BOX_MIN} AS core, count(*) AS n FROM g GROUP BY 1",
    "normalised_points": f"WITH {POINTS} SELECT part_id, point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM n",
    "pair_distances": f"""WITH {POINTS}, o AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY point_id) no, count(*) OVER (PARTITION BY part_id) size FROM n), d AS (SELECT part_id, size, unnest(range(1, 20001)) draw FROM (SELECT DISTINCT part_id, size FROM o) WHERE size >= 4),
        k AS (SELECT part_id, ('0x' || md5('i42:' || part_id || ':' || draw)[:8])::BIGINT % size + 1 AS i, ('0x' || md5('j42:' || part_id || ':' || draw)[:8])::BIGINT % size + 1 AS j FROM d),
        b AS (SELECT k.part_id, least(64, floor(least(1.0, round(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)) / sqrt(3.0), 9)) * 64) + 1)::INT AS bin FROM k JOIN o a ON a.part_id = k.part_id AND a.no = k.i JOIN o c ON c.part_id = k.part_id AND c.no = k.j)
        SELECT part_id, bin, round(count(*) / 20000, 6) AS share FROM b GROUP BY 1, 2""",
    "thinned_points": f"WITH {POINTS} SELECT part_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY md5('0:' || part_id || ':' || point_id), point_id) r FROM p) WHERE r <= 16",
    "face_type_hist": "SELECT l_orderkey AS part_id, " + ", ".join(f"round(avg((l_linenumber % 6 = {i})::INT), 6) AS {k}" for i, k in enumerate(("plane", "cylinder", "cone", "sphere", "torus", "free"))) + " FROM lineitem GROUP BY 1",
    "primitive_kinds": f"SELECT p.kind AS kind, count(*) AS n, round(avg(p.params['radius']), 4) AS mean_radius FROM (SELECT unnest(primitives) p FROM {HOLES}) GROUP BY 1",
    "bbox_ratio": "WITH b AS (SELECT l_suppkey, list_sort([(max(l_quantity) - min(l_quantity))::DOUBLE, (max(l_extendedprice / 1000) - min(l_extendedprice / 1000))::DOUBLE, (max(l_discount * 100) - min(l_discount * 100))::DOUBLE]) s FROM lineitem GROUP BY 1) SELECT l_suppkey, round(s[1] / (s[3] + 1e-12), 6) AS r1, round(s[2] / (s[3] + 1e-12), 6) AS r2 FROM b",
    "hist64": "WITH x AS (SELECT l_suppkey, l_quantity::DOUBLE / 50 q FROM lineitem), m AS (SELECT l_suppkey, avg(q) m FROM x GROUP BY 1), b AS (SELECT l_suppkey, least(64, floor(round(abs(q - m), 9) * 64) + 1)::INT AS bin, count(*) n FROM x JOIN m USING (l_suppkey) GROUP BY 1, 2) SELECT l_suppkey, bin, n, (sum(n) OVER (PARTITION BY l_suppkey))::BIGINT AS total FROM b",
    "roundness": """WITH p AS (SELECT l_suppkey, l_quantity::DOUBLE - 5 x, l_extendedprice::DOUBLE / 1000 - 2 y, l_discount::DOUBLE * 100 z FROM lineitem), q AS (SELECT l_suppkey, 0.6 * x + 0.8 * z t, x * x + y * y + z * z s FROM p), r AS (SELECT l_suppkey, t, sqrt(greatest(0.0, s - t * t)) r FROM q)
        SELECT l_suppkey, round(1 - least(1.0, stddev_pop(r) / (avg(r) + 1e-6)), 6) AS roundness, round(max(t) - min(t), 6) AS extent FROM r GROUP BY 1""",
    "mean_of_means": f"WITH {FACES}, k AS (SELECT part_id, face_no % 2 g, avg(ax) x, avg(ay) y, avg(az) z FROM f WHERE kind = 'cone' GROUP BY 1, 2), m AS (SELECT part_id, avg(x) x, avg(y) y, avg(z) z FROM k GROUP BY 1) SELECT part_id, round(coalesce(x, 0.0), 6) AS x, round(coalesce(y, 0.0), 6) AS y, round(coalesce(z, 0.0), 6) AS z FROM (SELECT DISTINCT part_id FROM f) LEFT JOIN m USING (part_id)",
    "coaxial_best_match": f"WITH {FACES}, {COAX} SELECT part_id, face_no, cone_no, round(coax_dot, 6) AS coax_dot FROM x",
    "hole_extraction": f"""WITH {FACES}, {COAX}, c AS (SELECT part_id, face_no, radius, depth, row_number() OVER (PARTITION BY part_id ORDER BY face_no, radius, depth) no FROM f WHERE kind = 'cylinder' AND radius >= 0.25), r AS (SELECT part_id, bool_or(kind = 'plane') ring FROM f GROUP BY 1)
        SELECT part_id, part_id || '::h' || lpad(no::VARCHAR, 4, '0') AS hole_id, 2 * radius AS D0, depth AS H0, 2 * x.semi_angle AS alpha0, round((coalesce(coax_dot, 1.0) + CASE WHEN ring THEN 1.0 ELSE 0.3 END) / 2, 6) AS q FROM c LEFT JOIN x USING (part_id, face_no) JOIN r USING (part_id) WHERE depth >= 5 AND radius >= 2""",
    "candidates_agg": f"""WITH {FACES}, c AS (SELECT part_id, face_no, radius, depth, ax / n ax, ay / n ay, az / n az FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) n FROM f WHERE kind = 'cylinder' AND depth >= 0)), r AS (SELECT part_id, arg_min(ax, face_no) rx, arg_min(ay, face_no) ry, arg_min(az, face_no) rz FROM c GROUP BY 1),
        s AS (SELECT c.*, CASE WHEN ax * rx + ay * ry + az * rz < 0 THEN -1.0 ELSE 1.0 END::DOUBLE s FROM c JOIN r USING (part_id)), m AS (SELECT part_id, median(2 * radius) D0, sum(depth) H0, avg(s * ax) x, avg(s * ay) y, avg(s * az) z FROM s GROUP BY 1), b AS (SELECT part_id, avg(cx) AS cx, avg(cy) AS cy, avg(cz) AS cz FROM (SELECT part_id, face_no, avg(ax) AS cx, avg(ay) AS cy, avg(az) AS cz FROM f WHERE kind = 'cone' GROUP BY 1, 2) GROUP BY 1)
        SELECT part_id, round(D0, 6) AS D0, round(H0, 6) AS H0, 90.0::DOUBLE AS alpha0, round(x / sqrt(x * x + y * y + z * z), 6) AS ax, round(y / sqrt(x * x + y * y + z * z), 6) AS ay, round(z / sqrt(x * x + y * y + z * z), 6) AS az, round(coalesce(cx, 0.0), 6) AS "bx", round(coalesce(cy, 0.0), 6) AS "by", round(coalesce(cz, 0.0), 6) AS "bz", 0.8::DOUBLE AS q FROM m LEFT JOIN b USING (part_id)""",
    "candidate_quality": f"SELECT hole_id, round((least(1.0, greatest(0.0, coalesce(nullif(flags.coax_dot, 0), 1.0))) + CASE WHEN flags.has_entry_ring THEN 1.0 ELSE 0.3 END) / 2, 6) AS quality FROM {HOLES}",
    "record_validation": f"SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN hole_id IS NULL THEN 'no_id' END, CASE WHEN D0 < 0 THEN 'negative_D0' END, CASE WHEN H0 < 0 THEN 'negative_H0' END, CASE WHEN q IS NULL OR q < 0 OR q > 1 THEN 'q_range' END, CASE WHEN primitives IS NULL OR len(primitives) = 0 THEN 'no_primitives' END], lambda x: x IS NOT NULL)) AS problem FROM {HOLES}) GROUP BY 1",
    "candidate_totals": "WITH p AS (SELECT source_dataset, part_id, count(*) n FROM (SELECT DISTINCT hole_id, part_id, source_dataset FROM hole_candidates) GROUP BY 1, 2) SELECT source_dataset, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, median(n)::DOUBLE AS p50, round(quantile_cont(n::DOUBLE, 0.9), 6) AS p90, max(n) AS most FROM p GROUP BY 1",
    "capped_sample": "SELECT hole_id, part_id FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY hole_id) r FROM (SELECT DISTINCT hole_id, part_id FROM hole_candidates)) WHERE r <= 3",
    "recall_match": f"WITH {FACES}, {PAIRS}, {HIT} SELECT * FROM h",
    "recall_wilson": f"""WITH {FACES}, {PAIRS}, {HIT}, k AS (SELECT kind, count(h.gt_id) AS hits, count(*) AS n FROM t LEFT JOIN h ON t.part_id = h.part_id AND t.face_no = h.gt_id GROUP BY 1), w AS (SELECT *, hits / n AS p, 1.96 AS z FROM k)
        SELECT kind, hits, n, round(p, 6) AS recall, round(greatest(0.0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1.0, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM w""",
    "param_grid": f"WITH {FACES}, {PAIRS}, {GRID} SELECT tol, iou_min, hits, n, round(hits / n, 6) AS recall FROM r",
    "tuned_setting": f"WITH {FACES}, {PAIRS}, {GRID}, s AS (SELECT tol, iou_min, hits, n, round(hits / n, 6) AS recall FROM r) SELECT * FROM s ORDER BY recall >= 0.3 DESC, CASE WHEN recall >= 0.3 THEN tol END, recall DESC, iou_min DESC, tol LIMIT 1",
    "weighted_recall": f"WITH {FACES}, {PAIRS}, {HIT}, p AS (SELECT part_id, count(*) n FROM t GROUP BY 1), q AS (SELECT part_id, count(*) k FROM h GROUP BY 1) SELECT count(*) AS n_parts, round(sum(coalesce(k, 0) / n * greatest(1, n)) / sum(greatest(1, n)), 6) AS recall FROM p LEFT JOIN q USING (part_id)",
    "stress_evaluation": f"""WITH {FACES}, {PAIRS}, {HIT}, k AS (SELECT part_id, count(*) hits FROM h GROUP BY 1), p AS (SELECT part_id, count(*) FILTER (face_no % 2 = 1) nt, count(*) FILTER (face_no % 2 = 0) nf, sum(depth) ms, count(*) n FROM f GROUP BY 1),
        r AS (SELECT *, CASE WHEN n = 1 THEN 'error' WHEN ms > 200 THEN 'timeout' ELSE 'ok' END st, CASE WHEN n = 1 THEN 0 WHEN ms > 200 THEN 1 ELSE greatest(1, nt) END w FROM p LEFT JOIN k USING (part_id))
        SELECT round(sum(CASE WHEN st = 'ok' AND nt > 0 THEN coalesce(hits, 0) / nt * w ELSE 0 END) / sum(w), 6) AS recall, round(median(ms) FILTER (st = 'ok'), 4) AS median_ms, round(avg(nf) FILTER (st = 'ok'), 6) AS per_part, sum(w)::BIGINT AS n FROM r""",
    "real_evaluation": f"WITH p AS (SELECT part_id, count(*) k, median(H0) ms FROM {HOLES} GROUP BY 1) SELECT 0.0::DOUBLE AS recall, round(median(ms), 4) AS median_ms, round(avg(k), 6) AS per_part, count(*) AS n FROM p WHERE ms IS NOT NULL",
    "tuning_trials": f"""WITH {FACES}, {PAIRS}, g AS (SELECT unnest([5.73, 6.23, 6.73]::DOUBLE[]) AS setting), k AS (SELECT avg(c) c FROM (SELECT count(*) FILTER (face_no % 2 = 0) c FROM f GROUP BY part_id)), r AS (SELECT setting, round((SELECT count(DISTINCT (part_id, gt_id)) FROM m WHERE angle <= setting AND iou >= 0.7) / (SELECT count(*) FROM t), 6) AS recall FROM g)
        SELECT setting, recall, round(c, 6) AS per_part, recall >= 0.05 AS ok FROM r, k""",
    "recall_with_centres": f"""WITH {FACES}, t AS (SELECT * FROM f WHERE face_no % 2 = 1) SELECT DISTINCT a.part_id, a.face_no AS gt_id FROM t a JOIN f b USING (part_id) WHERE b.face_no % 2 = 0 AND round(degrees(acos(least(1.0, greatest(-1.0, {COS})))), 6) <= CASE WHEN a.semi_angle <= 45 THEN 5.73 ELSE 8.0 END
        AND round(least(a.depth, b.depth) / greatest(a.depth, b.depth), 6) >= 0.7 AND sqrt(pow(10 * a.ax - 10 * b.ax, 2) + pow(10 * a.ay - 10 * b.ay, 2)) <= greatest(0.01 * 2 * a.radius, 0.2)""",
    "report_samples": f"WITH k AS (SELECT hole_id, CASE WHEN D0 IS NULL THEN 'no_candidate' WHEN primitives IS NULL OR len(primitives) = 0 THEN 'parse_error' WHEN H0 IS NULL OR H0 < 0 THEN 'error' END AS kind FROM {HOLES}) SELECT hole_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY hole_id) r FROM k WHERE kind IS NOT NULL) WHERE r <= CASE kind WHEN 'error' THEN 20 ELSE 200 END",
    "face_probe": f"WITH {FACES}, {PROBE} SELECT * FROM w",
    "no_candidate_sums": f"WITH {FACES}, {PROBE} SELECT count(*) AS n_parts, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("faces", "planes", "cylinders", "cones", "narrow", "shallow", "upright")) + " FROM w WHERE fit = 0",
    "geom_hash_classes": f"WITH {USABLE}, h AS (SELECT part_id, list_transform(bbox_ratio || surf_hist, lambda x: round(x, 2)) h FROM u) SELECT min(part_id) AS first, count(*) AS n FROM h GROUP BY h HAVING count(*) > 1",
    "staged_tuning": f"""WITH {FACES}, {PAIRS}, {GRID}, a AS (SELECT tol, round(hits / n, 6) rec FROM r WHERE iou_min = 0.7 ORDER BY rec DESC, tol LIMIT 1), b AS (SELECT iou_min, round(hits / n, 6) rec FROM r WHERE tol = (SELECT tol FROM a) ORDER BY rec DESC, iou_min DESC LIMIT 1)
        SELECT 'tol' AS stage, tol AS value, rec AS recall FROM a UNION ALL SELECT 'iou', iou_min, rec FROM b""",
    "report_pass": f"WITH {FACES}, {PAIRS}, {GRID}, s AS (SELECT tol, iou_min, round(hits / n, 6) AS recall FROM r) SELECT recall, recall >= 0.3 AS passed FROM s ORDER BY recall >= 0.3 DESC, CASE WHEN recall >= 0.3 THEN tol END, recall DESC, iou_min DESC, tol LIMIT 1",
    "stress_set": f"""WITH s AS (SELECT p_partkey, 1.5 * pow(2.0, 5 * {_u('D')}) d, {_u('H')} h, [0.0, 15.0, 30.0, 45.0, 60.0][floor({_u('T')} * 5)::INT + 1]::DOUBLE AS tilt, CASE WHEN {_u('K')} < 0.5 THEN 'countersink' ELSE 'plain' END AS kind FROM part)
        SELECT p_partkey, round(d, 6) AS D, round(d * (0.5 + 5.5 * h), 6) AS H, tilt, kind, round(-sin(radians(tilt)), 6) AS ay, round(cos(radians(tilt)), 6) AS az FROM s""",
    "status_counts": "SELECT event_type, coalesce(CASE WHEN props IS NULL THEN NULL WHEN contains(lower(props), 'read') AND (contains(lower(props), 'fail') OR contains(lower(props), 'error')) THEN 'read_fail' WHEN contains(lower(props), 'timeout') OR contains(lower(props), 'timed out') THEN 'timeout' WHEN contains(lower(props), 'no such file') OR contains(lower(props), 'missing') THEN 'missing_file' ELSE 'other_error' END, 'none') AS error, count(*) AS n FROM events GROUP BY 1, 2",
    "status_rollup": "SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type)",
    "latency_quantiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, max(value) AS max FROM events GROUP BY 1",
}
