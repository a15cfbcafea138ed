"""Queries over the driver's tables, one for each operator, bound to the order panel.

px is the nation, day the shipping day, v the mean quantity, n the number of lines, u the mean price and t a temperature made
of u. The pseudo-grid has five rows and columns of places. Thresholds are parameters; those here give events on these
tables. Results are rounded, so that sums taken in another order compare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import asof, frames, grid
from .functions.quartiles import percentile_table, quartile_of, with_quartile
from .operators import anomaly, clusters, composite, enrich, events, landcover, parts, regions, regrid, sensitivity, stats
from .operators.events import Rule
from .oracle import ORACLE_SQL
from .plans import buckets, jobs
from .plans.panel import clipped, materialised, new_path, order_panel, order_values, read
from .registry import Variable
from .sources import classic, ingest

RULE = Rule(prior=-0.25, after=-0.5, below=-0.5, min_days=7)
LAGS = 30
SPAN = ("1995-01-01", "2001-11-04")
YEARS = (1995, 2000)
#: land-cover key: public legend codes of the classes that the fixture uses
KEY = [("cropland_rainfed", 10), ("cropland_rainfed_herbaceous_cover", 11), ("cropland_rainfed_tree_or_shrub_cover", 12), ("shrubland", 120), ("grassland", 130), ("sparse_vegetation", 150)]
CODES = [10, 11, 120, 130, 150]


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return order_panel(spark, sf)


def z_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with standardised anomalies z of v, and n as it is."""
    return anomaly.standardised(panel(spark, sf), "v")


def zu_panel(spark: SparkSession, sf: str) -> DataFrame:
    """z and the standardised anomaly zu of u."""
    return anomaly.standardised(z_panel(spark, sf), "u", name="zu")


def feats(spark: SparkSession, sf: str) -> DataFrame:
    return events.features(z_panel(spark, sf))


def event_rows(spark: SparkSession, sf: str, rule: Rule = RULE) -> tuple[DataFrame, DataFrame]:
    f = materialised(feats(spark, sf))
    return events.intervals(f, rule), f


def onsets(spark: SparkSession, sf: str) -> DataFrame:
    """The events, written once: a few rows a place that plans below read more than once."""
    return materialised(events.intervals(feats(spark, sf), RULE))


def onsets_and_panel(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The events and the panel with z and zu that they are from, each written once."""
    both = materialised(zu_panel(spark, sf))
    return materialised(events.intervals(events.features(both), RULE)), both


def located(cat: DataFrame) -> DataFrame:
    return cat.withColumn("lat", F.lit(4.0) + F.floor(F.col("px") / 5) * 4.0).withColumn("lon", F.lit(-18.0) + (F.col("px") % 5) * 7.0)


def land_cover(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    years = F.explode(F.sequence(F.lit(YEARS[0]), F.lit(YEARS[1])))
    nations = read(spark, sf, "nation").select(F.col("n_nationkey").alias("px"), "n_regionkey").withColumn("year", years)
    pick = (F.col("n_regionkey") + F.col("year") + F.col("px")) % len(CODES)
    cover = nations.select("px", "year", F.element_at(F.array(*map(F.lit, CODES)), pick + 1).alias("class"))
    return cover, spark.createDataFrame(KEY, "land_cover string, flag int")


def catalogue(spark: SparkSession, sf: str, rule: Rule = RULE) -> DataFrame:
    return events.catalogue(*event_rows(spark, sf, rule))


def r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(f"`{c}`", digits) for c in cols})


def entry(spark: SparkSession) -> DataFrame:
    """Event catalogue of the smallest tables."""
    return catalogue(spark, "/root/testdata/sf0.001", Rule(prior=-0.25, after=-0.5, below=-0.5, min_days=3, frozen=None))


# --- windows, climatology, anomalies


def panel_daily(spark, sf):
    return r(r(panel(spark, sf), "v", "t", digits=9), "u")


def _window(col, name, expr):
    def run(spark, sf):
        return r(panel(spark, sf).select("px", "day", expr(col).alias(name)), name)

    return run


rolling_centred_mean = _window("v", "mean_5d", lambda c: frames.centred_mean(c, 5, 2))
rolling_trailing_mean = _window("v", "mean_30d", lambda c: frames.trailing_mean(c, 30, 5))
rolling_leading_min = _window("v", "min_next_20d", lambda c: frames.leading_min(c, 20))
rolling_leading_max = _window("v", "max_20d", lambda c: frames.leading_max(c, 20, 2))
rolling_centred_min = _window("t", "min_61d", lambda c: frames.centred_min(c, 61))


def climatology(spark, sf):
    return r(r(anomaly.climatology(panel(spark, sf), "v"), "clim_mean", digits=9), "clim_std")


def climatology_by_parts(spark, sf):
    """The climatology of parts by year and by turn of the year, from a table by year."""
    path = new_path(spark, "years")
    ingest.write_years(panel(spark, sf).select("px", "day", "v"), path)
    years = spark.read.parquet(path).drop("year")
    return r(r(parts.merged(parts.year_parts(years, "v").unionByName(parts.turn_parts(years, "v"))), "clim_mean", digits=9), "clim_std")


def std_anomaly(spark, sf):
    return r(z_panel(spark, sf).select("px", "day", "z"), "z")


def anomaly_mean_only(spark, sf):
    return r(anomaly.departures(panel(spark, sf), "v").select("px", "day", "d"), "d", digits=9)


def climatology_observed(spark, sf):
    return r(r(anomaly.observed_climatology(panel(spark, sf), "v").select("px", "day", "clim_mean", "clim_std"), "clim_mean", digits=9), "clim_std")


def detrend(spark, sf):
    return r(anomaly.detrended(panel(spark, sf), "v").select("px", "day", "detrended"), "detrended")


def detection_features(spark, sf):
    return events.features(z_panel(spark, sf), digits=6)


# --- events


def drought_mask(spark, sf):
    return events.mask(onsets(spark, sf))


def event_catalogue(spark, sf):
    return r(catalogue(spark, sf), "max_intensity")


def event_catalogue_growing_season(spark, sf):
    f = feats(spark, sf)
    return r(events.catalogue(events.intervals(f, RULE, events.peak_month(panel(spark, sf), "u")), f), "max_intensity")


def runs_of_mask(spark, sf):
    return events.runs_of_mask(panel(spark, sf).withColumn("flag", F.coalesce(F.col("v") < 20, F.lit(False))))


def places(spark, sf):
    return read(spark, sf, "nation").select(F.col("n_nationkey").alias("px"))


def onset_count_map(spark, sf):
    return events.onset_counts(onsets(spark, sf), places(spark, sf))


def places_without_events(spark, sf):
    rare = events.intervals(feats(spark, sf), Rule(prior=-0.25, after=-1.0, below=-1.0, min_days=6))
    return events.places_with_events(rare, places(spark, sf), any_event=False)


def peak_month(spark, sf):
    return events.peak_month(panel(spark, sf), "u")


# --- land cover and composites


def land_cover_daily(spark, sf):
    cover, _ = land_cover(spark, sf)
    return landcover.class_of_day(panel(spark, sf).select("px", "day"), cover, first=YEARS[0], last=YEARS[1])


def land_cover_nearest(spark, sf):
    """The class nearest in time where each place has stamps of its own, at uneven distances."""
    cover, _ = land_cover(spark, sf)
    stamps = cover.withColumn("stamp", F.make_date(F.col("year"), F.lit(1) + (F.col("px") * 5 + F.col("year") * 3) % 12, F.lit(1) + (F.col("px") * 7 + F.col("year")) % 28).cast("timestamp"))
    return asof.with_nearest(panel(spark, sf).select("px", "day"), stamps, ["px"], "day", "stamp", ["class"])


def top_land_cover_map(spark, sf):
    return landcover.top_map(land_cover(spark, sf)[0], 1998, [10, 120, 130], onsets(spark, sf))


def composite_plain(spark, sf):
    return r(composite.composite(*onsets_and_panel(spark, sf), "zu", LAGS), "composite_mean")


def composite_spread(spark, sf):
    return r(composite.composite(*onsets_and_panel(spark, sf), "zu", LAGS, spread=True), "composite_mean", "composite_std")


def composite_land_cover(spark, sf):
    cover, key = land_cover(spark, sf)
    found, both = onsets_and_panel(spark, sf)
    rows = landcover.class_of_day(found, cover, "start", *YEARS)
    rows = rows.withColumn("land_cover", landcover.group_name(F.col("class"), key)).filter("land_cover is not null")
    return r(composite.composite(rows, both, "zu", LAGS, by=["land_cover"]), "composite_mean")


def composite_one_group(spark, sf):
    cover, key = land_cover(spark, sf)
    found, both = onsets_and_panel(spark, sf)
    rows = landcover.in_group(found, cover, key, "all_cropland_rainfed", "start", first=YEARS[0], last=YEARS[1])
    return r(composite.composite(rows, both, "zu", LAGS), "composite_mean")


def composite_weighted(spark, sf):
    return r(composite.composite(*onsets_and_panel(spark, sf), "zu", LAGS, weight="n", least=2), "composite_mean", "composite_total_obs")


def peaks(found: DataFrame, both: DataFrame) -> DataFrame:
    """Event starts with the greatest u of the next 20 days, of days with two lines or more."""
    p = ingest.least_count(both, "u", "n", 2).select("px", "day", frames.leading_max("u", 20, 2).alias("peak"))
    return found.join(p.withColumnRenamed("day", "start"), ["px", "start"], "left")


def event_percentiles(spark, sf):
    return r(percentile_table(peaks(*onsets_and_panel(spark, sf)), "peak"), "value")


def event_quartiles(spark, sf):
    return r(with_quartile(peaks(*onsets_and_panel(spark, sf)), "peak").select("px", "start", "peak", F.coalesce("quartile", F.lit(0)).alias("quartile")), "peak")


def _by_quartile(spark, sf) -> tuple[DataFrame, DataFrame]:
    found, both = onsets_and_panel(spark, sf)
    return with_quartile(peaks(found, both), "peak").filter("quartile is not null"), both


def composite_quartile(spark, sf):
    return r(composite.composite(*_by_quartile(spark, sf), "zu", LAGS, by=["quartile"]), "composite_mean")


def composite_weighted_quartile(spark, sf):
    return r(composite.composite(*_by_quartile(spark, sf), "zu", LAGS, by=["quartile"], weight="n", least=2), "composite_mean", "composite_total_obs")


def composite_smoothed(spark, sf):
    return r(composite.smoothed(composite.composite(*onsets_and_panel(spark, sf), "zu", LAGS)), "composite_mean", "composite_smooth")


# --- enrichment


def _enrich(kind, smooth=None, first=0, last=20):
    def run(spark, sf):
        name = enrich.column_name("u", kind, first, last, smooth=smooth)
        out = enrich.add_window(*onsets_and_panel(spark, sf), "zu", "u", kind, first, last, smooth, span=SPAN)
        return r(out, name).withColumnRenamed(name, "value")

    return run


def _enrich_sums(kind, smooth=None, first=0, last=20):
    def run(spark, sf):
        name = enrich.column_name("u", kind, first, last, smooth=smooth)
        out = enrich.add_window_by_sums(*onsets_and_panel(spark, sf), "zu", "u", kind, first, last, smooth, span=SPAN)
        return r(out, name).withColumnRenamed(name, "value")

    return run


def enrich_named(spark, sf):
    """Two windows added under their generated names."""
    found, both = onsets_and_panel(spark, sf)
    out = enrich.add_window(found, both, "zu", "u", "max", 0, 20, span=SPAN)
    out = enrich.add_window(out, both, "z", "v", "mean", -30, -1, 5, span=SPAN)
    return r(out, enrich.column_name("u", "max", 0, 20), enrich.column_name("v", "mean", -30, -1, smooth=5))


def _enrich_weighted(kind, smooth=None, first=0, last=20, compat=False):
    def run(spark, sf):
        name, count = (enrich.column_name("u", kind, first, last, True, smooth, p) for p in ("std_anom", "n"))
        found, both = onsets_and_panel(spark, sf)
        out = enrich.add_weighted_window(found, both.select("px", "day", "zu", "n"), "zu", "n", "u", kind, first, last, 2, smooth, span=SPAN, compat_argmin=compat)
        return r(out, name, count).withColumnRenamed(name, "value").withColumnRenamed(count, "obs")

    return run


# --- regions and statistics


def regional_catalogue(spark, sf):
    return r(regions.regional(located(catalogue(spark, sf)), "west_africa", "MJJAS"), "max_intensity")


def regional_count_grid(spark, sf):
    return regions.count_grid(regions.regional(located(onsets(spark, sf)), "west_africa"))


def catalogue_bands(spark, sf):
    far = onsets(spark, sf).withColumn("lat", F.lit(-50.0) + F.col("px") * 5.0)
    return regions.banded(far).select("px", "start", "lat", "band", "band_order")


def enriched(spark, sf) -> DataFrame:
    """Events with a response and a predictor: greatest zu of 0..20 and mean z of -30..-1."""
    found, p = onsets_and_panel(spark, sf)
    out = enrich.add_window(found, p, "zu", "u", "max", 0, 20, span=SPAN)
    out = enrich.add_window(out, p, "z", "z", "mean", -30, -1, span=SPAN)
    response, predictor = enrich.column_name("u", "max", 0, 20), enrich.column_name("z", "mean", -30, -1)
    return materialised(out.select("px", "start", "end", F.round(f"`{response}`", 9).alias("response"), F.round(f"`{predictor}`", 9).alias("predictor")))


def exceedance_report(spark, sf):
    return r(stats.exceedance(enriched(spark, sf), "response", "predictor", 1.5), "percent")


def kde_by_quartile(spark, sf):
    rows = with_quartile(enriched(spark, sf).dropna(subset=["response", "predictor"]), "predictor")
    return r(stats.density(rows, "response", "quartile", -4.0, 6.0, 51), "x", "density")


def response_histogram(spark, sf):
    return r(stats.histogram(enriched(spark, sf), "response"), "low", "high")


def mann_whitney(spark, sf):
    return r(stats.observed(enriched(spark, sf), "response", "predictor"), "u", "p")


def box_sensitivity(spark, sf):
    box = lambda c: grid.box_index(c, 2)
    found, both = onsets_and_panel(spark, sf)
    rows = found.withColumn("box_i", box(F.floor(F.col("px") / 5))).withColumn("box_j", box(F.col("px") % 5))
    return r(sensitivity.sensitivity(rows, both, "z", "zu", ["box_i", "box_j"], least=20), "sensitivity").withColumn("n", F.col("n").cast("bigint"))


def keyed(found: DataFrame) -> DataFrame:
    cat = found.withColumn("row", F.floor(F.col("px") / 5).cast("int")).withColumn("col", F.col("px") % 5)
    return cat.withColumn("key", F.datediff("start", F.lit("1995-01-01").cast("date")).cast("bigint") * 100 + F.col("px"))


def event_clusters(spark, sf):
    return clusters.cluster(keyed(onsets(spark, sf)), reach=1).select("px", "start", "cluster_id")


def _clustered(spark, sf) -> DataFrame:
    rows = enriched(spark, sf)
    return clusters.add_clusters(rows, clusters.cluster(keyed(rows), reach=0))


def bootstrap_samples(spark, sf):
    rows = _clustered(spark, sf)
    return r(stats.bootstrap(rows, "response", "predictor", "cluster_id"), "p")


def bootstrap_bound(spark, sf):
    rows = _clustered(spark, sf)
    return r(stats.bound(stats.bootstrap(rows, "response", "predictor", "cluster_id")), "bound")


# --- ingest


def ingest_mask_shift_crop(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), (F.lit(-70.0) + F.col("o_custkey") % 160).alias("lat"), (F.lit(-180.0) + F.col("o_custkey") % 360).alias("lon"))
    out = ingest.apply_rule(rows, Variable("value", below=250000.0, shift_hours=-12))
    return out.select("o_orderkey", "day", "lat", "lon", F.round(F.col("value").cast("double"), 2).alias("value"))


def regrid_half_cell(spark, sf):
    rows = panel(spark, sf).select("day", F.floor(F.col("px") / 5).cast("int").alias("row"), (F.col("px") % 5).alias("col"), F.col("v").alias("value"))
    return r(ingest.half_cell_regrid(rows), "value")


def regrid_linear(spark, sf):
    """The five by five places on a coarser grid whose columns descend, with one coordinate beyond the end."""
    rows = panel(spark, sf).select("day", F.floor(F.col("px") / 5).cast("int").alias("row"), (F.col("px") % 5).cast("int").alias("col"), F.col("v").alias("value"))
    lat, lon = regrid.axis(spark, [0.0, 1.0, 2.0, 3.0, 4.0], [0.5, 2.0, 3.25]), regrid.axis(spark, [0.0, 1.0, 2.0, 3.0, 4.0], [4.5, 2.75, 0.25])
    return r(regrid.regridded(rows, lat, lon), "value")


def merged_files(spark, sf):
    """Tables of three spans of days, with columns in another order, as one panel."""
    v, path = r(panel(spark, sf), "v", digits=9), new_path(spark, "spans")
    for name, lo, hi, cols in (("a", "1995-01-01", "1996-12-31", ["px", "day", "v"]), ("b", "1997-01-01", "1999-05-31", ["v", "day", "px"]), ("c", "1999-06-01", "2001-11-04", ["day", "px", "v"])):
        v.filter(F.col("day").between(lo, hi)).select(*cols).coalesce(1).write.parquet(f"{path}/{name}")
    return ingest.read_merged(spark, [f"{path}/{x}" for x in "abc"], ["v"])


def land_fraction_mask(spark, sf):
    land = read(spark, sf, "nation").select(F.floor(F.col("n_nationkey") / 5).cast("int").alias("row"), (F.col("n_nationkey") % 5).alias("col"), (F.col("n_regionkey") / 4.0).alias("land_fraction"))
    rows = panel(spark, sf).select("day", F.floor(F.col("px") / 5).cast("int").alias("row"), (F.col("px") % 5).alias("col"), F.col("v").alias("value"))
    return r(ingest.land_only(rows, land), "value")


def quality_threshold(spark, sf):
    rows = panel(spark, sf).select("px", "day", "v", F.coalesce("n", F.lit(0)).alias("n"))
    return r(ingest.least_count(rows, "v", "n", 2, zero_counts=True), "v", digits=9)


def tile_counts(spark, sf):
    """Observed cells by tile of the pseudo-grid."""
    t = panel(spark, sf).select(grid.tile_index(F.floor(F.col("px") / 5), 5, 2).alias("tile_i"), grid.tile_index(F.col("px") % 5, 5, 3).alias("tile_j"), "v")
    return t.groupBy("tile_i", "tile_j").agg(F.count("v").alias("observed"))


def event_type_daily(spark, sf):
    """A second panel: events by user and hour of the month, its rolling mean and quartile."""
    e = read(spark, sf, "events").groupBy(F.col("user_id").alias("px"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 9).alias("value"), F.count(F.lit(1)).alias("n"))
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"), F.expr("interval 1 day")))
    dense = e.select("px").distinct().withColumn("day", days).join(e, ["px", "day"], "left")
    out = dense.withColumn("mean_5d", frames.centred_mean("value", 5, 2))
    return r(out.select("px", "day", "n", "mean_5d"), "mean_5d")


# --- sources and sinks, each written to the shared folder and read back


def catalogue_csv(spark, sf):
    path = new_path(spark, "catalogue")
    ingest.write_catalogue_csv(located(r(catalogue(spark, sf), "max_intensity")), path)
    return ingest.read_catalogue_csv(spark, path)


def enriched_csv(spark, sf):
    """The enriched catalogue by latitude bands, with its further column."""
    rows, path = _enrich("max")(spark, sf), new_path(spark, "enriched")
    rows = located(rows).withColumn("length", F.datediff("end", "start")).withColumn("max_intensity", F.lit(None).cast("double"))
    ingest.write_catalogue_csv(rows, path, bands=True)
    return ingest.read_catalogue_csv(spark, path).select("lat", "lon", "start", "end", "length", "value")


def numbers_text(spark, sf):
    path = new_path(spark, "numbers")
    ingest.write_numbers(r(panel(spark, sf), "v", digits=9), "v", path)
    return ingest.read_numbers(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def count_map_npy(spark, sf):
    """Events by place as a two-dimensional map, in files of two by two places."""
    path = new_path(spark, "map")
    counts = onset_count_map(spark, sf).withColumns({"i": F.floor(F.col("px") / 5).cast("int"), "j": (F.col("px") % 5).cast("int")})
    ingest.write_map(counts, 5, 5, path, value="n_events", tile=2)
    return ingest.read_map(spark, path)


def year_tables(spark, sf):
    """Three years of a table written by year; a second job leaves the table alone."""
    path = new_path(spark, "years")
    ingest.write_years(r(panel(spark, sf), "v", digits=9).select("px", "day", "v"), path)
    if not ingest.exists(spark, path) or ingest.write_once(panel(spark, sf).limit(0), path):
        raise RuntimeError("a finished table was written again")
    return ingest.read_years(spark, path, 1996, 1998, ["px", "day", "v"])


def files_by_name(spark, sf):
    """The years 1997 and 1998 by the names of their folders."""
    path = new_path(spark, "years")
    ingest.write_years(r(panel(spark, sf), "v", digits=9).select("px", "day", "v"), path)
    rows = ingest.read_files_with(spark, path, "=1997").unionByName(ingest.read_files_with(spark, path, "=1998"))
    return rows.groupBy("px").agg(F.count(F.lit(1)).alias("days"), F.count("v").alias("observed"))


def netcdf_years(spark, sf):
    """The panel as a grid in one file a year, and two years of its southern rows read back."""
    spark.dataSource.register(classic.ClassicSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    path = new_path(spark, "grid")
    cells = panel(spark, sf).select(F.col("day").cast("timestamp_ntz").alias("ts"), (F.lit(0.5) + F.floor(F.col("px") / 5)).cast("double").alias("lat"), (F.lit(0.5) + F.col("px") % 5).cast("double").alias("lon"), F.col("v").alias("value"), F.year("day").alias("year"))
    dealt = cells.repartition("year").sortWithinPartitions("ts").drop("year")
    grid_of = {"variable": "v", "south": "0", "west": "0", "step": "1", "rows": "5", "cols": "5", "first": SPAN[0], "last": SPAN[1], "units": "lines", "prefix": "v"}
    dealt.write.format("netcdf_classic").options(**grid_of).mode("append").save(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("netcdf_classic").option("variable", "v").load(path)
        kept = rows.filter(F.col("ts").between(F.lit("1996-07-01").cast("timestamp_ntz"), F.lit("1998-02-28").cast("timestamp_ntz")) & (F.col("lat") < 3))
        return materialised(kept.select("lat", "lon", F.to_date("ts").alias("day"), "value"))
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


# --- whole jobs


JOB = Variable("v", below=45.0, shift_hours=-12, regrid=True, first_year=1996, last_year=1999)


def anomaly_job(spark, sf):
    """Raw values through fill limit, time shift, regridding, land mask, crop and anomaly to tables by year, read back."""
    raw = panel(spark, sf).select(F.col("day").cast("timestamp").alias("ts"), F.floor(F.col("px") / 5).cast("int").alias("row"), (F.col("px") % 5).cast("int").alias("col"), F.col("v").alias("value"))
    nations = read(spark, sf, "nation").select(F.col("n_nationkey").alias("px"), F.floor(F.col("n_nationkey") / 5).cast("int").alias("row"), (F.col("n_nationkey") % 5).cast("int").alias("col"), (F.col("n_regionkey") / 4.0).alias("land_fraction"))
    kept = nations.filter("row < 4 and col < 4").select("px")
    path = new_path(spark, "anomalies")
    jobs.save_anomalies(raw, JOB, kept, path, land=nations.drop("px"), south=20.0, west=-180.0, step=20.0, cols=5)
    return r(ingest.read_years(spark, path, 1996, 1999, ["px", "day", "value", "z"]), "value", "z", digits=5)


def rolling_job(spark, sf):
    """The five windows of the panel as a table by year, of which three years are read back."""
    path = new_path(spark, "rolling")
    jobs.save_rolling(panel(spark, sf), path)
    out = ingest.read_years(spark, path, 1996, 1998, ["px", "day", "mean_5d", "min_61d", "mean_30d", "min_next_20d", "max_20d"])
    return r(out, "mean_5d", "min_61d", "mean_30d", "min_next_20d", "max_20d")


def composite_bucketed(spark, sf):
    """The composite of one bucketed panel around the events of another; neither is exchanged again."""
    found, both = onsets_and_panel(spark, sf)
    z = buckets.bucketed(both.select("px", "day", "z", "t"), 4, "z")
    zu = buckets.bucketed(both.select("px", "day", "zu"), 4, "zu")
    with buckets.bucket_joins(spark):
        events_of = events.intervals(events.features(z), RULE)
        return materialised(r(composite.composite(events_of, zu, "zu", LAGS), "composite_mean"))


def composites_all(spark, sf):
    """Composites of two variables by land cover and quartile, 120 lags, in one pass over the panel."""
    cover, key = land_cover(spark, sf)
    found, both = onsets_and_panel(spark, sf)
    stack = jobs.stacked({"v": both.select("px", "day", F.col("z"))}).unionByName(jobs.stacked({"u": both.select("px", "day", F.col("zu"))}, "zu"))
    rows = materialised(peaks(found, both))
    return r(jobs.all_composites(rows, stack, cover, key, lags=120, quartiles="peak", first=YEARS[0], last=YEARS[1]).filter("composite_n > 0"), "composite_mean")


def composite_wide(spark, sf):
    return r(composite.composite(*onsets_and_panel(spark, sf), "zu", 240), "composite_mean")


def common_span(spark, sf):
    """Two panels of unlike spans, cut to the days that both cover."""
    v = order_values(spark, sf).select("px", "day", "v")
    a, b = clipped(v.filter("day >= date'1996-02-10'"), v.filter("day <= date'1999-10-20'"))
    return a.groupBy("px").agg(F.min("day").alias("first"), F.count(F.lit(1)).alias("n")).join(b.groupBy("px").agg(F.max("day").alias("last")), "px")


def valid_places(spark, sf):
    static = read(spark, sf, "nation").select(F.col("n_nationkey").alias("px"), (F.col("n_regionkey") > 0).cast("int").alias("land"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey") % 2).alias("rainforest"))
    return ingest.valid_places(static).select("px")


def nearest_pixels(spark, sf):
    """The cell of each customer's made-up point, with its coordinates to three places."""
    points = read(spark, sf, "customer").select("c_custkey", (F.lit(-59.95) + F.col("c_custkey") % 1000 * F.lit(0.1370001)).alias("lat"), (F.lit(-179.9) + F.col("c_custkey") % 700 * F.lit(0.5110003)).alias("lon"))
    out = points.withColumn("pixel", grid.pixel_id(F.col("lat"), F.col("lon")))
    return ingest.described(out, {"pixel": "cell of the quarter-degree grid"})


def sensitivity_map(spark, sf):
    """The sensitivity of every box of the map, those without events too."""
    return sensitivity.on_grid(box_sensitivity(spark, sf), 4, 4)


def event_clusters_wide(spark, sf):
    return clusters.cluster(keyed(onsets(spark, sf))).select("px", "start", "cluster_id")


def cluster_sizes(spark, sf):
    return clusters.sizes(clusters.cluster(keyed(onsets(spark, sf)), reach=1))


QUERIES = {
    "panel_daily": panel_daily,
    "rolling_centred_mean": rolling_centred_mean,
    "rolling_trailing_mean": rolling_trailing_mean,
    "rolling_leading_min": rolling_leading_min,
    "rolling_leading_max": rolling_leading_max,
    "rolling_centred_min": rolling_centred_min,
    "climatology": climatology,
    "climatology_by_parts": climatology_by_parts,
    "std_anomaly": std_anomaly,
    "anomaly_mean_only": anomaly_mean_only,
    "climatology_observed": climatology_observed,
    "detrend": detrend,
    "detection_features": detection_features,
    "drought_mask": drought_mask,
    "event_catalogue": event_catalogue,
    "event_catalogue_growing_season": event_catalogue_growing_season,
    "runs_of_mask": runs_of_mask,
    "onset_count_map": onset_count_map,
    "places_without_events": places_without_events,
    "peak_month": peak_month,
    "land_cover_daily": land_cover_daily,
    "land_cover_nearest": land_cover_nearest,
    "top_land_cover_map": top_land_cover_map,
    "composite": composite_plain,
    "composite_spread": composite_spread,
    "composite_land_cover": composite_land_cover,
    "composite_one_group": composite_one_group,
    "composite_weighted": composite_weighted,
    "event_percentiles": event_percentiles,
    "event_quartiles": event_quartiles,
    "composite_quartile": composite_quartile,
    "composite_weighted_quartile": composite_weighted_quartile,
    "composite_smoothed": composite_smoothed,
    "enrich_mean": _enrich("mean", first=-30, last=-1),
    "enrich_min": _enrich("min"),
    "enrich_max": _enrich("max"),
    "enrich_sum": _enrich("sum"),
    "enrich_smooth": _enrich("max", smooth=5),
    "enrich_mean_sums": _enrich_sums("mean", first=-30, last=-1),
    "enrich_min_sums": _enrich_sums("min"),
    "enrich_sum_sums": _enrich_sums("sum"),
    "enrich_smooth_sums": _enrich_sums("max", smooth=5),
    "enrich_named": enrich_named,
    "enrich_weighted_mean": _enrich_weighted("mean"),
    "enrich_weighted_min": _enrich_weighted("min"),
    "enrich_weighted_max": _enrich_weighted("max", smooth=5),
    "enrich_weighted_compat": _enrich_weighted("max", compat=True),
    "regional_catalogue": regional_catalogue,
    "regional_count_grid": regional_count_grid,
    "catalogue_bands": catalogue_bands,
    "exceedance_report": exceedance_report,
    "kde_by_quartile": kde_by_quartile,
    "response_histogram": response_histogram,
    "mann_whitney": mann_whitney,
    "sensitivity": box_sensitivity,
    "event_clusters": event_clusters,
    "bootstrap_samples": bootstrap_samples,
    "bootstrap_bound": bootstrap_bound,
    "ingest_mask_shift_crop": ingest_mask_shift_crop,
    "regrid_half_cell": regrid_half_cell,
    "regrid_linear": regrid_linear,
    "merged_files": merged_files,
    "land_fraction_mask": land_fraction_mask,
    "quality_threshold": quality_threshold,
    "tile_counts": tile_counts,
    "event_type_daily": event_type_daily,
    "catalogue_csv": catalogue_csv,
    "enriched_csv": enriched_csv,
    "numbers_text": numbers_text,
    "count_map_npy": count_map_npy,
    "year_tables": year_tables,
    "files_by_name": files_by_name,
    "netcdf_years": netcdf_years,
    "rolling_job": rolling_job,
    "composite_bucketed": composite_bucketed,
    "anomaly_job": anomaly_job,
    "composites_all": composites_all,
    "composite_wide": composite_wide,
    "common_span": common_span,
    "valid_places": valid_places,
    "nearest_pixels": nearest_pixels,
    "sensitivity_map": sensitivity_map,
    "event_clusters_wide": event_clusters_wide,
    "cluster_sizes": cluster_sizes,
}

__all__ = ["ORACLE_SQL", "QUERIES", "entry", "quartile_of"]
