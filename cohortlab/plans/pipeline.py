"""Shared artifacts of the analysis, computed once per (session, data folder).

The raw entity table and the filtered table are the fan-out points of every
report: each is written once to the shared checkpoint folder (lineage cut;
survives executor loss) and read back.  Model artifacts are small driver-side objects (coefficients, tree
nodes, merge lists) derived from single aggregation passes.
"""

from __future__ import annotations

from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import cells, encode, linear, moments, quality, sampling, segments, tree
from cohortlab.roles import (
    ALPHA_GRID,
    CV_FOLDS,
    ENTITY,
    ENTITY_CLUSTER_FEATURES,
    L1_RATIO_GRID,
    DISTANCE_METRICS,
    LINKAGE_METHODS,
    NUM_CELLS,
    NUM_CLUSTERS,
    PRUNED_DEPTH,
    SAMPLE_SIZE,
    SPLIT_SEED,
    TEST_FRACTION,
    Roles,
)
from cohortlab.session import scratch_path
from cohortlab.sources.fixtures import entity_view

_CACHE: dict[tuple, "Pipeline"] = {}


def pipeline(spark: SparkSession, sf_dir: str) -> "Pipeline":
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CACHE:
        _CACHE[key] = Pipeline(spark, sf_dir.rstrip("/"))
    return _CACHE[key]


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back (cuts lineage)."""
    path = scratch_path(df.sparkSession, kind)
    df.write.option("parquet.block.size", tree.ROW_GROUP).parquet(path)
    return df.sparkSession.read.parquet(path)


class Pipeline:
    def __init__(self, spark: SparkSession, sf_dir: str, roles: Roles = ENTITY):
        self.spark, self.sf_dir, self.roles = spark, sf_dir, roles

    # ------------------------------------------------------------ cleaning
    @cached_property
    def raw(self) -> DataFrame:
        """The raw entity table, written once (one row per order): the raw-side
        reports and the cleaning chain read it instead of re-aggregating lines."""
        return materialize(entity_view(self.spark, self.sf_dir), "raw")

    @cached_property
    def _clean(self):
        # the filtered frame is written once; the statistics pass and every
        # report then read it instead of recomputing the entity view
        base = materialize(quality.filtered(self.raw, self.roles), "filtered")
        med, modes = quality.impute_values(base, self.roles)
        return quality.fill(base, self.roles, med, modes), med, modes

    @property
    def clean(self) -> DataFrame:
        return self._clean[0]

    @property
    def medians(self) -> dict:
        return self._clean[1]

    @property
    def modes(self) -> dict:
        return self._clean[2]

    # ------------------------------------------------------------ encoding
    @cached_property
    def _encoded(self):
        r = self.roles
        df = encode.ordinal_encode(self.clean, r.ordinal_column, r.ordinal_order, "shift_rank")
        enc, dictionary = encode.label_encode(df, list(r.categorical))
        return enc, dictionary

    @property
    def encoded(self) -> DataFrame:
        return self._encoded[0]

    @property
    def dictionary(self) -> DataFrame:
        return self._encoded[1]

    # ------------------------------------------------------------ splits
    @cached_property
    def tree_data(self) -> DataFrame:
        """Encoded rows + ``is_test`` (exact stratified 70/30 on the target)."""
        df = sampling.stratified_split(self.encoded, self.roles.id, self.roles.target, TEST_FRACTION, SPLIT_SEED)
        return materialize(df, "tree-data")

    @cached_property
    def reg_data(self) -> DataFrame:
        """Encoded rows + ``is_test`` (hash 70/30) + ``fold`` + ``grp`` (test | f0..f4)."""
        df = sampling.hash_split(self.encoded, self.roles.id, TEST_FRACTION, SPLIT_SEED)
        df = sampling.assign_folds(df, self.roles.id, CV_FOLDS, SPLIT_SEED)
        return df.withColumn("grp", F.when(F.col("is_test"), F.lit("test")).otherwise(F.concat(F.lit("f"), F.col("fold").cast("string"))))

    # ------------------------------------------------------------ tree
    @property
    def tree_features(self) -> list[str]:
        return self.roles.tree_features()

    @cached_property
    def tree(self) -> tree.TreeFit:
        train = self.tree_data.where(~F.col("is_test"))
        return tree.fit_tree(train, self.tree_features, self.roles.target)

    @cached_property
    def pruned_tree(self) -> tree.TreeFit:
        """The tree of PRUNED_DEPTH levels: the unpruned one cut there (greedy trees are nested), which is used if it is known already."""
        if "tree" in self.__dict__:
            return self.tree
        train = self.tree_data.where(~F.col("is_test"))
        return tree.fit_tree(train, self.tree_features, self.roles.target, max_depth=PRUNED_DEPTH)

    @cached_property
    def tree_scored(self) -> DataFrame:
        """The split rows (id, target, is_test) with their leaf and P(class 1), written once."""
        return materialize(tree.with_leaf(self.tree, self.tree_data, [self.roles.id, self.roles.target, "is_test"]), "tree-scored")

    @cached_property
    def curve(self) -> DataFrame:
        counts = self.tree_scored.groupBy("is_test", "leaf", F.col(self.roles.target).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
        return tree.depth_curve(self.tree, counts)

    # ------------------------------------------------------------ regression
    @property
    def reg_features(self) -> list[str]:
        return self.roles.regression_features()

    @cached_property
    def grams(self) -> dict:
        shift = {c: self.medians.get(c, 0.0) for c in self.roles.numeric}
        return moments.gram(self.reg_data, self.reg_features, self.roles.regression_target, group="grp", shift=shift)

    @property
    def fold_grams(self) -> dict:
        return {int(k[1:]): g for k, g in self.grams.items() if k != "test"}

    @property
    def train_gram(self) -> moments.Gram:
        return moments.total(self.fold_grams)

    @property
    def test_gram(self) -> moments.Gram:
        return self.grams["test"]

    @cached_property
    def ols(self) -> linear.LinearFit:
        return linear.ols(self.train_gram)

    @cached_property
    def ridge_cv(self):
        grid = [(a, 0.0) for a in ALPHA_GRID]
        rows = linear.cv_grid(self.fold_grams, grid, "ridge")
        alpha, _ = linear.best_params(rows, grid)
        return rows, linear.ridge(self.train_gram, alpha)

    @cached_property
    def lasso_cv(self):
        grid = [(a, 1.0) for a in ALPHA_GRID]
        rows = linear.cv_grid(self.fold_grams, grid, "enet")
        alpha, _ = linear.best_params(rows, grid)
        return rows, linear.enet(self.train_gram, alpha, 1.0)

    @cached_property
    def enet_cv(self):
        grid = [(a, r) for a in ALPHA_GRID for r in L1_RATIO_GRID]
        rows = linear.cv_grid(self.fold_grams, grid, "enet")
        alpha, l1 = linear.best_params(rows, grid)
        return rows, linear.enet(self.train_gram, alpha, l1)

    def models(self) -> dict[str, linear.LinearFit]:
        return {"OLS": self.ols, "Ridge": self.ridge_cv[1], "Lasso": self.lasso_cv[1], "ElasticNet": self.enet_cv[1]}

    # ------------------------------------------------------------ segments
    @cached_property
    def scaler(self) -> dict:
        return moments.zscore_fit(self.clean, list(ENTITY_CLUSTER_FEATURES))

    @cached_property
    def sample(self) -> DataFrame:
        """The stratified fixed-size sample (clean columns + z-scored features)."""
        s = sampling.stratified_sample(self.clean, self.roles.id, self.roles.target, SAMPLE_SIZE, SPLIT_SEED)
        s = s.where(F.col("in_sample")).drop("in_sample")
        return materialize(moments.zscore_apply(s, self.scaler, suffix="_z"), "sample")

    @cached_property
    def points(self) -> DataFrame:
        return segments.vectorize(self.sample, self.roles.id, [c + "_z" for c in ENTITY_CLUSTER_FEATURES])

    @cached_property
    def pairs(self) -> DataFrame:
        """Pairwise distances of the sample (bounded: sample size² / 2 rows), written once."""
        return materialize(segments.pairwise(self.points), "pairs")

    @cached_property
    def standardized(self) -> DataFrame:
        """All clean rows with z-scored features and their vector."""
        z = moments.zscore_apply(self.clean, self.scaler, suffix="_z")
        return z.withColumn("vec", F.array(*(F.col(c + "_z") for c in ENTITY_CLUSTER_FEATURES)))

    @cached_property
    def cells(self) -> cells.Cells:
        """The weighted cells of all clean rows; the rows with their cell are written once."""
        found = cells.feature_cells(self.standardized, NUM_CELLS)
        found.rows = materialize(found.rows, "cell-rows")
        return found

    def _link(self, combos) -> segments.Linkage:
        return segments.agglomerate(self.cells.frame().withColumnRenamed("cell", "id"), combos)

    @cached_property
    def linkage(self) -> segments.Linkage:
        """All valid (linkage, metric) combinations, computed in shared rounds."""
        return self._link(segments.valid_combinations(LINKAGE_METHODS, DISTANCE_METRICS))

    def _labels_of(self, lk: segments.Linkage) -> pd.DataFrame:
        return segments.label_rows(lk, segments.cut_labels(lk, NUM_CLUSTERS))

    @cached_property
    def cell_labels(self) -> pd.DataFrame:
        """(method, metric, cell, cluster) of every combination."""
        return self._labels_of(self.linkage)

    @cached_property
    def labels(self) -> DataFrame:
        """(method, metric, id, cluster) of every clean row and combination: a join on the cell."""
        found = F.broadcast(self.spark.createDataFrame(self.cell_labels))  # combinations × cells, bounded
        return self.cells.rows.join(found, "cell").select("method", "metric", F.col(self.roles.id).alias("id"), F.col("cluster").cast("int").alias("cluster"))

    @cached_property
    def _single(self) -> dict:
        return {}

    def labels_for(self, method: str, metric: str = "euclidean") -> pd.DataFrame:
        """One labelling of the cells; computes only that combination unless all are already known."""
        if "linkage" in self.__dict__:
            lab = self.cell_labels
        else:
            key = (method, metric)
            if key not in self._single:
                self._single[key] = self._labels_of(self._link([key]))
            lab = self._single[key]
        return lab[(lab["method"] == method) & (lab["metric"] == metric)][["cell", "cluster"]]

    def segmented(self, method: str, metric: str = "euclidean") -> DataFrame:
        """Every clean row (columns, z-scored features) with the cluster of its cell."""
        found = self.spark.createDataFrame(self.labels_for(method, metric), "cell int, cluster int")
        return self.cells.rows.join(F.broadcast(found), "cell").drop("cell", "vec")
