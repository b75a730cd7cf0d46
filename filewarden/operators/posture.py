"""Configuration rules over an inventory of sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewarden.functions.text import version_key


def recommendations(sites: DataFrame, latest_version: Column) -> DataFrame:
    """One row per site and broken rule.

    `latest_version` is a literal or a scalar subquery; NULL (unknown) raises no
    update row. An unset editing or debug switch counts as unsafe.
    """

    def rule(broken: Column, title: str, description: Column, severity: str) -> Column:
        fields = (F.lit(title).alias("title"), description.alias("description"), F.lit(severity).alias("severity"))
        return F.when(broken, F.struct(*fields))

    rules = F.array(
        rule(
            ~F.coalesce("disallow_file_edit", F.lit(False)),
            "Built-in file editor is on",
            F.lit("DISALLOW_FILE_EDIT is not true: whoever gets hold of an administrator session can change code on this site."),
            "high",
        ),
        rule(
            F.coalesce("debug", F.lit(True)),
            "Debug output is on",
            F.lit("WP_DEBUG is not false: visitors may get to see file paths, queries and error texts."),
            "medium",
        ),
        rule(
            F.coalesce(version_key(F.col("version")) < version_key(latest_version), F.lit(False)),
            "Core is behind",
            F.format_string("The site runs core %s; the newest release is %s.", "version", latest_version),
            "high",
        ),
    )
    return sites.select("site", F.inline(F.array_compact(rules)))
