"""Document quality: independent reasons, acceptance and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import unused
from . import text as T

# Thresholds and patterns of the quality rules.
MIN_CLASSICAL, MIN_OTHER, MAX_LENGTH = 20, 80, 2_000_000
RUN_LENGTH, MAX_DUPLICATE_LINES, MIN_CJK = 12, 0.45, 0.25
CJK_CATEGORIES = ("classical", "general_zh", "stem_technical")
WEB_NOISE = "点击下载|立即注册|ICP备|cookie policy|javascript is required|广告合作"
STEM_TERMS = "定理|证明|方程|函数|算法|数据结构|物理|化学|生物|工程|programming|algorithm|theorem"


def reasons(text: Column, category: Column) -> Column:
    """All reasons to reject, in a fixed order."""
    least = F.when(category == "classical", MIN_CLASSICAL).otherwise(MIN_OTHER)
    rules = {
        "too_short": F.length(text) < least,
        "too_long": F.length(text) > MAX_LENGTH,
        "replacement_character": F.contains(text, F.lit("�")),
        "repeated_character_run": T.has_run(text, RUN_LENGTH),
        "web_boilerplate": text.rlike(f"(?iu){WEB_NOISE}"),
        "repeated_lines": T.duplicate_line_ratio(text) > MAX_DUPLICATE_LINES,
        "low_cjk_ratio": category.isin(*CJK_CATEGORIES) & (T.cjk_ratio(text) < MIN_CJK),
    }
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))


def accepted(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (``text``, ``category``) without any of :func:`reasons`.

    Spark moves a filter below the projection that makes ``text`` and then makes
    it anew for each rule, but moves none below one that holds a random column.
    """
    found, still = unused(df.columns, "found", "still")
    rows = df.withColumns({found: reasons(F.col("text"), F.col("category")), still: F.rand(0)})
    return rows.where((F.size(found) == 0) & (F.col(still) >= 0)).drop(found, still)


def score(text: Column, found: Column) -> Column:
    """0.8 and up to 0.2 for length, less 0.22 for each reason."""
    by_length = F.least(F.lit(0.2), F.log10(F.greatest(F.length(text), F.lit(10))) / 20)
    return F.round(F.greatest(F.lit(0.0), 0.8 + by_length - F.least(F.lit(1.0), 0.22 * F.size(found))), 4)


def looks_technical(text: Column) -> Column:
    """Two or more technical terms, repeats included."""
    return F.regexp_count(text, F.lit(f"(?iu){STEM_TERMS}")) >= 2
