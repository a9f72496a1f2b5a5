"""weftline: entity resolution, evidence extraction and data-quality operators on Spark DataFrames."""

from weftline.session import build_session, recommended_conf

__all__ = ["build_session", "recommended_conf"]
