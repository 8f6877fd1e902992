"""End-to-end plans: boxes -> declarations -> rules -> verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartonscope.operators import anchors as A
from cartonscope.operators import extraction as E
from cartonscope.operators import layout as L
from cartonscope.operators import merging as M
from cartonscope.operators import rollups as R
from cartonscope.operators import rules as RU
from cartonscope.session import shared_folder
from cartonscope.sources import readers, sinks


def staged(df: DataFrame) -> DataFrame:
    """Cuts the plan where its result has several readers, so the work below runs once and survives
    the loss of executors. Its files lie in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def declarations_of(primary: DataFrame, meta: DataFrame, secondary: DataFrame | None = None,
                    answers: DataFrame | None = None, dictionary: A.Dictionary | None = None) -> DataFrame:
    """One row per scan of ``meta``: primary reader, then second pass, vision, catalogue, calibration."""
    d = E.with_unread_scans(meta, E.extract_declarations(primary, dictionary))
    if secondary is not None:
        d = M.merge_passes(d, E.extract_declarations(secondary, dictionary))
    if answers is not None:
        d = M.merge_vision(d, readers.parse_reader_answers(answers))
    return L.calibrate(E.apply_overrides(d, meta))


def results_of(declarations: DataFrame, primary: DataFrame, registry: RU.Registry | None = None) -> DataFrame:
    """All registered rules. Only the clear-space rule looks at boxes again."""
    registry = registry or RU.default_registry()
    if registry.needs_clear_space():
        declarations = RU.with_clear_space(declarations, primary)
    return RU.run_rules(declarations, registry)


def price_rule_shares(regions: DataFrame, meta: DataFrame) -> DataFrame:
    """Labels passing, failing or undecided on the price rule."""
    results = results_of(declarations_of(regions, meta), regions, RU.default_registry("R6-7"))
    return R.scans_by_status(results.select(F.col("status").alias("overall_status")))


def scan_labels(scans: DataFrame, boxes: DataFrame, answers: DataFrame | None = None,
                registry: RU.Registry | None = None) -> DataFrame:
    """Register rows of a batch of scans. ``scans`` carries the catalogue columns and created_at;
    ``boxes`` all readers' boxes with reader ``p`` (primary) and ``s``."""
    primary = boxes.filter("reader = 'p'")
    declarations = staged(declarations_of(primary, scans, boxes.filter("reader = 's'"), answers))
    registry = registry or RU.default_registry()
    ready = RU.with_clear_space(declarations, primary) if registry.needs_clear_space() else declarations
    return sinks.scan_records(RU.run_rules(ready, registry), scans, declarations, boxes)
