"""String expressions: configuration labels, display names, significance text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIG_PATTERN = r"^(?:(cca)_pca(\d+)|(scca)_pca(\d+)_c(\d+(?:\.\d+)?)_(\d+(?:\.\d+)?))$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _plain(number) -> Column:
    """A number in plain digits, never with an exponent, at least one digit after the point."""
    return F.regexp_replace(F.format_string("%.12f", _col(number).cast("double")), r"(\.\d+?)0+$", "$1")


def config_label(method, dim, c1, c2) -> Column:
    """`cca_pca128` for the plain method, `scca_pca64_c0.1_0.3` for the sparse one."""
    head = F.concat(_col(method), F.lit("_pca"), _col(dim).cast("string"))
    return F.when(_col(method) == "cca", head).otherwise(
        F.concat(head, F.lit("_c"), _plain(c1), F.lit("_"), _plain(c2))
    )


def parse_config(label) -> Column:
    """Inverse of `config_label` as struct(method, dim, c1, c2); other text is an error."""
    text = F.trim(_col(label))

    def group(n: int) -> Column:
        return F.nullif(F.regexp_extract(text, CONFIG_PATTERN, n), F.lit(""))

    parsed = F.struct(
        F.coalesce(group(1), group(3)).alias("method"),
        F.coalesce(group(2), group(4)).cast("int").alias("dim"),
        group(5).cast("double").alias("c1"),
        group(6).cast("double").alias("c2"),
    )
    bad = F.raise_error(F.concat(F.lit("unparseable configuration label: "), text))
    return F.when(text.rlike(CONFIG_PATTERN), parsed).otherwise(
        bad.cast("struct<method:string,dim:int,c1:double,c2:double>")
    )


def display_name(column, description, category=None, include_col: bool = False) -> Column:
    """`Category: Description [column]`, falling back to the description, then the raw name."""
    col = _col(column)
    desc = F.trim(F.coalesce(_col(description), F.lit("")))
    cat = F.trim(F.coalesce(_col(category), F.lit(""))) if category is not None else F.lit("")
    base = (
        F.when((desc != "") & (cat != ""), F.concat(cat, F.lit(": "), desc)).when(desc != "", desc).otherwise(col)
    )
    return F.concat(base, F.lit(" ["), col, F.lit("]")) if include_col else base


def significance_stars(p) -> Column:
    x = _col(p)
    return F.when(x < 0.001, "***").when(x < 0.01, "**").when(x < 0.05, "*").otherwise("")


def format_p_value(p) -> Column:
    x = _col(p)
    return F.when(x.isNull(), "").when(x < 0.001, "p<.001").otherwise(F.format_string("p=%.3f", x))


def network_of(roi_name) -> Column:
    """Third `_` token of a region name, empty when there is none."""
    return F.coalesce(F.get(F.split(_col(roi_name), "_"), F.lit(2)), F.lit(""))


def title_label(name) -> Column:
    return F.initcap(F.replace(_col(name), F.lit("_"), F.lit(" ")))


DEFAULT_KEY_SUFFIX = "_20227_2_0"  # fixed value


def subject_key(path, subject_id, prefix: str, default_suffix: str = DEFAULT_KEY_SUFFIX) -> Column:
    """Key after `prefix` in a file stem, else the default name of the subject."""
    found = F.nullif(F.regexp_extract(_col(path), prefix + r"([^/]+?)(?:\.[^./]+)?$", 1), F.lit(""))
    return F.coalesce(found, F.concat(_col(subject_id), F.lit(default_suffix)))
