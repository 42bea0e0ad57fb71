"""URL filter by rules and by a tree of path templates, in native expressions.

Each host has a tree of path segments.  Segments that vary become wildcards,
siblings that behave alike become one branch, and a template whose labelled
URLs are mostly bad is rejected.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.work import Scratch


@dataclass(frozen=True)
class Rule:
    """Blocks or allows a host, its subdomains, and the paths below ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    """A node with ``support`` URLs or more, or with labelled and unlabelled ones, is split by its next segment; siblings merge if none of
    their rates differs from the others' by ``differ`` standard errors; a template is rejected if
    (bad + 1) / (labelled + 2) is above ``reject``."""

    support: int = 8
    differ: float = 2.0
    reject: float = 0.7


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``, and for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def parsed(urls: DataFrame) -> DataFrame:
    """``urls`` (column url) with host and path; columns so named are replaced."""
    host, path = host_and_path(F.col("url"))
    rest = [c for c in urls.columns if c not in ("host", "path")]
    return urls.select(*rest, host.alias("host"), path.alias("path"))


def by_rule(rules: Sequence[Rule], value: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits columns host and path; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        inside = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        found = F.when(inside & F.col("path").startswith(rule.path), F.lit(getattr(rule, value))).otherwise(found)
    return found


def _shape(segment: Column) -> Column:
    """A segment with its numbers and long hexadecimal strings blanked."""
    hexadecimal = F.regexp_replace(segment, r"(?i)(?=[0-9a-f-]*[0-9])[0-9a-f]{8}[0-9a-f-]*", "{x}")
    return F.regexp_replace(hexadecimal, r"[0-9]+", "{n}")


def _differs(own: Column, own_n: Column, whole: Column, whole_n: Column, errors: float, more: int) -> Column:
    """Whether a share among ``own_n`` differs from the share among the rest of ``whole_n``.

    Either side counts ``more`` hits and misses more than it has: with one, a
    side without evidence lies half way, unlike one that is clearly good or bad.
    """
    rest, rest_n = whole - own + more, whole_n - own_n + 2 * more
    own, own_n = own + more, own_n + 2 * more
    pooled = (own + rest) / (own_n + rest_n)
    error = F.sqrt(pooled * (1 - pooled) * (1 / own_n + 1 / rest_n))
    apart = F.abs(own / own_n - rest / rest_n) > F.lit(errors) * error
    return F.when((own_n > 0) & (rest_n > 0), apart).otherwise(False)


def _rates(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of URLs, labelled ones and bad ones, and those that end with this segment."""
    return rows.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.sum("labelled").alias("labelled"),
        F.sum(F.when(F.size("segments") == F.col("depth") + 1, F.col("n")).otherwise(0)).alias("ends"),
    )


def _level(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows at one depth of the tree, moved one segment down: template and depth grow."""
    segment = F.get("segments", F.col("depth"))
    rows = rows.withColumn("segment", segment).withColumn("shape", _shape(F.col("segment")))
    node = ["host", "template"]
    values = rows.select(*node, "shape", "segment").distinct().groupBy(*node, "shape").agg(F.count(F.lit(1)).alias("values"))
    own = _rates(rows, *node, "shape").join(values, [*node, "shape"])
    whole = own.groupBy(*node).agg(
        F.count(F.lit(1)).alias("kinds"),
        *[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "labelled", "ends")],
    )
    own = own.join(whole, node)
    unlike = _differs(F.col("bad"), F.col("labelled"), F.col("all_bad"), F.col("all_labelled"), settings.differ, 1)
    unlike |= _differs(F.col("ends"), F.col("n"), F.col("all_ends"), F.col("all_n"), settings.differ, 0)
    varies = F.col("kinds") * 2 > F.col("all_n")
    merged = (F.col("kinds") >= 3) & (varies | ~unlike)
    own = own.select(*node, "shape", merged.alias("merged"), "values")
    rows = rows.join(own, [*node, "shape"])
    blank = F.when(F.col("values") > 1, F.col("shape")).otherwise(F.col("segment"))
    token = F.when(F.col("merged"), F.lit("*")).otherwise(blank)
    rows = rows.withColumn("template", F.concat("template", F.lit("/"), token)).withColumn("depth", F.col("depth") + 1)
    return rows.drop("segment", "shape", "merged", "values")


def _along_chains(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows with ``split``, whether their node is split, moved down to where the node's paths part.

    A node is split if it has ``support`` URLs, or holds both labelled and
    unlabelled ones, which are judged apart at any size.  Segments that all
    paths of a node share would be a level each; the least and the greatest path
    of a node share just those.
    """
    node = ["host", "template"]
    own = rows.groupBy(*node).agg(
        F.sum("n").alias("crowd"),
        F.sum("labelled").alias("marked"),
        F.min("segments").alias("low"),
        F.max("segments").alias("high"),
    )
    alike = F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y))
    parts = F.array_position(alike, F.lit(False))
    shared = F.when(parts > 0, parts - 1).otherwise(F.size("low")).cast("int")
    split = (F.col("crowd") >= settings.support) | ((F.col("marked") > 0) & (F.col("marked") < F.col("crowd")))
    moved = rows.join(own.select(*node, split.alias("split"), shared.alias("shared")), node)
    ahead = F.greatest("shared", "depth") - F.col("depth")
    chain = F.transform(F.slice("segments", F.col("depth") + 1, ahead), lambda s: F.concat(F.lit("/"), s))
    template = F.concat("template", F.array_join(chain, ""))
    moved = moved.withColumns(
        {
            "template": F.when(F.col("split"), template).otherwise(F.col("template")),
            "depth": F.when(F.col("split"), F.greatest("shared", "depth")).otherwise(F.col("depth")),
        }
    )
    return moved.drop("shared")


def templates(urls: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> DataFrame:
    """host, path, template, labelled, purity and rejected of every distinct (host, path).

    ``urls`` has host, path and label (1 bad, 0 good, null unknown).  URLs that
    share host and path are counted first.  The tree grows a level at a time,
    shared segments at once, as deep as nodes are split; the rest of a path is ``/**``.
    Purity is (bad + 1) / (labelled + 2): without labels a template is not rejected.
    """
    label = F.col("label")
    rows = urls.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(label, F.lit(0))).alias("bad"), F.count(label).alias("labelled")
    )
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    rows = rows.withColumns({"segments": segments, "template": F.lit(""), "depth": F.lit(0)})
    columns = rows.columns
    open_rows, finished, level = scratch.write(rows, "level-0"), [], 0
    while True:
        marked = _along_chains(open_rows, settings)
        goes_on = (F.size("segments") > F.col("depth")) & F.col("split")
        tail = F.when(F.size("segments") > F.col("depth"), F.lit("/**")).otherwise(F.lit(""))
        stays = marked.filter(~goes_on).withColumn("template", F.concat("template", tail)).select(*columns)
        finished.append(scratch.write(stays, f"done-{level}"))
        level += 1
        open_rows = scratch.write(_level(marked.filter(goes_on).select(*columns), settings).select(*columns), f"level-{level}")
        if open_rows.isEmpty():
            break
    everything = finished[0]
    for part in finished[1:]:
        everything = everything.unionByName(part)
    per = everything.groupBy("host", "template").agg(F.sum("bad").alias("t_bad"), F.sum("labelled").alias("t_labelled"))
    purity = (F.col("t_bad") + 1) / (F.col("t_labelled") + 2)
    per = per.select("host", "template", F.col("t_labelled").alias("template_labels"), purity.alias("purity"))
    found = everything.join(per, ["host", "template"])
    return found.select(
        "host", "path", "template", "template_labels", "purity", (F.col("purity") > settings.reject).alias("rejected")
    )


def judged(pages: DataFrame, scratch: Scratch, rules: Sequence[Rule] = RULES, settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row of ``pages`` (page_id, url).

    The longest fitting rule decides.  Rules also label the tree: what they
    block is bad, what they allow is good; URLs beyond all rules are judged by
    their template.  Null URLs and those without ``://`` have an empty host and
    path and are one template; repeated rows and ids stay.
    """
    rows = parsed(pages.select("page_id", "url"))
    rows = rows.withColumns({"rule": by_rule(rules, "text"), "ruled": by_rule(rules, "verdict")})
    label = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    found = templates(rows.select("host", "path", label.alias("label")), scratch, settings)
    both = rows.join(found, ["host", "path"])
    by_template = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce("ruled", by_template)
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
