"""Spark-first preparation, profiling and target analysis of tabular data.

Names are imported when they are used, so that Python workers load only what they need.
"""

from importlib import import_module

_WHERE = {
    "DataAnalyzer": "operators.profile",
    "DataPreprocessor": "operators.clean",
    "FeatureEngineer": "operators.features",
    "FeatureEngineeringBase": "operators.base",
    "FeatureSelector": "operators.selection",
    "TargetAnalyzer": "operators.target",
    "quick_analysis": "operators.profile",
    "select_features_auto": "operators.selection",
    "ColumnNotFoundError": "errors",
    "ConstantColumnError": "errors",
    "DataTypeError": "errors",
    "EmptyDataFrameError": "errors",
    "InsufficientDataError": "errors",
    "InvalidMethodError": "errors",
    "InvalidStrategyError": "errors",
    "MLToolkitError": "errors",
    "TransformerNotFittedError": "errors",
    "ValidationError": "errors",
}
__all__ = [*_WHERE, "statistical_utils"]


def __getattr__(name: str):
    if name == "statistical_utils":
        return import_module(".functions.statistics", __name__)
    if name in _WHERE:
        return getattr(import_module(f".{_WHERE[name]}", __name__), name)
    raise AttributeError(name)
