"""The fixture feeds of one data folder and the results several queries share."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import spark_view
from transitlapse.operators import diff as D
from transitlapse.operators import frequency as FQ
from transitlapse.operators import geometry as G
from transitlapse.operators import grades as GR
from transitlapse.operators import population as P
from transitlapse.operators import pyramid as Y
from transitlapse.operators import registry as R
from transitlapse.operators import timeline as T
from transitlapse.schema import STEM_COLUMNS, Feeds, conform
from transitlapse.session import cut_lineage, shared_folder

# The map request used by the raster queries: west, south, east, north.
VIEW = (13.0, 47.0, 14.9, 47.9)
POP_VIEW = (13.2, 47.1, 14.6, 47.7)
POP_EXTENT = (13.0, 47.0, 15.1, 48.0)


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def view(self, name: str) -> DataFrame:
        return spark_view(self.spark, self.sf_dir, name)

    @cached_property
    def feeds(self) -> Feeds:
        tables = {stem: conform(self.view(f"fx_{stem}"), stem) for stem in STEM_COLUMNS}
        files = self.view("fx_files").select("feed_id", "stem", F.split("cols", ",").alias("columns"))
        return Feeds(feeds=self.view("fx_feeds"), files=files, **tables)

    @cached_property
    def registry(self) -> R.Registry:
        return R.build_registry(self.feeds)

    @cached_property
    def pair(self) -> DataFrame:
        return cut_lineage(T.auto_pair(self.feeds))

    @cached_property
    def steps(self) -> DataFrame:
        return cut_lineage(T.feed_steps(self.feeds))

    @cached_property
    def pairs(self) -> DataFrame:
        return cut_lineage(self.steps.unionByName(self.pair).distinct())

    @cached_property
    def stop_diff(self) -> DataFrame:
        return cut_lineage(D.stop_diff(self.registry, self.pairs))

    @cached_property
    def route_diff(self) -> DataFrame:
        return cut_lineage(D.route_diff(self.registry, self.pairs))

    @cached_property
    def runs(self) -> DataFrame:
        return G.geometry_diff(self.feeds, self.registry, self.route_diff)

    @cached_property
    def features(self) -> DataFrame:
        return cut_lineage(G.run_features(self.feeds, self.runs, self.route_diff))

    @cached_property
    def freq_diff(self) -> DataFrame:
        return cut_lineage(FQ.frequency_diff(self.feeds, self.registry, self.route_diff))

    @cached_property
    def ranked_stops(self) -> DataFrame:
        return cut_lineage(GR.stop_categories(self.feeds))

    @cached_property
    def window(self) -> GR.CellWindow:
        return GR.cell_window(VIEW)

    @cached_property
    def grid(self) -> DataFrame:
        return cut_lineage(GR.grade_grid(self.ranked_stops, self.window))

    @cached_property
    def year_pairs(self) -> DataFrame:
        years = T.feed_years(self.feeds).select("feed_id", "year")
        side = lambda x: years.select(F.col("feed_id").alias(f"feed_{x}"), F.col("year").alias(f"year_{x}"))
        return self.pairs.join(side("a"), "feed_a").join(side("b"), "feed_b")

    @cached_property
    def pyramid(self) -> Y.Pyramid:
        """The pixels stored in tiles: small ones, as the given pixels cover two degrees only."""
        made = Y.Pyramid(f"{shared_folder(self.spark)}/pyramid-{uuid.uuid4().hex}", (1, 2, 4, 8), 512)
        Y.store_pyramid(self.view("fx_pop_pixels"), made)
        return made

    pop_view = P.pixel_window(POP_VIEW)
    pop_extent = P.pixel_window(POP_EXTENT)
    pop_wide = Y.aligned_window(POP_VIEW, 8)


_shared: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """One workspace per running application and folder: the registry is built once, as a user would."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _shared:
        _shared[key] = Workspace(spark, sf_dir)
    return _shared[key]


def forget() -> None:
    _shared.clear()
