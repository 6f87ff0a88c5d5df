"""airloom: Spark-first analytics for passive-sampler air-quality tables.

The public functions are found here by name; their modules are imported when first asked for."""

from __future__ import annotations

import importlib

_HOMES = {
    "session": "TubeError",
    "functions.expressions": "get_tube_x check_tube_data ExpressionError",
    "functions.labels": "quick_text",
    "sources.tubes": "dt_brd dt_calendar aurn_example",
    "sources.typed_json": "read_rjson",
    "sources.polygons": "PolygonLayer caz_brd read_geojson",
    "operators.tagging": "tag_tube tag_tube_required tag_tube_start_end tag_tube_lat_lon tag_tube_sample_id tag_tube_value tag_tube_date tag_tube_month tag_tube_year tag_tube_location",
    "operators.aggregate": "calc_tube_stat calc_tube_apply",
    "operators.merge": "r_merge",
    "operators.summaries": "tube_summary tube_summary_sample tube_summary_lat_lon",
    "operators.meta": "check_tube_meta extract_tube_meta add_tube_meta extract_and_add_tube_meta pad_tube_meta repair_tube_meta test_tube_meta",
    "operators.annual": "tube_annual_cover tube_annual_test",
    "operators.precision": "test_tube_precision TestResult",
    "operators.accuracy": "test_tube_accuracy find_near_lat_lon range_average",
    "operators.deseason": "deseason_tube_data",
    "operators.surface": "fit_tube_model fit_tube_model_loess fit_tube_model_gam",
    "operators.loess": "r_loess",
    "operators.gam": "fit_tensor_gam",
    "operators.cluster": "cluster_tube_data pam",
    "operators.polygon": "tube_in_xy_polygon",
    "plans.figures": "tube_plot tube_time_plot TubePlot",
    "plans.maps": "tube_map leaflet_tube_map LeafletMap",
    "streaming.rolling": "windowed_stat running_coverage",
}
_BY_NAME = {name: home for home, names in _HOMES.items() for name in names.split()}
__all__ = sorted(_BY_NAME)


def __getattr__(name: str):
    if name in _BY_NAME:
        return getattr(importlib.import_module(f"{__name__}.{_BY_NAME[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
