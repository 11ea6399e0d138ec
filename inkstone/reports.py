"""Reports of scored rows as columns of HTML, and the folder they are written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.operators import residue_python

# How channels and rules are named to a reader.
CHANNEL_LABELS = {"prompt_structure": "Prompt structure", "stylometry": "Stylometry", "continuation": "Continuation", "windowing": "Windowing"}
RULE_LABELS = {
    "L0_critical_preamble": "Critical preamble", "primary_red_with_corroboration": "Red channel, corroborated", "primary_red_short_text_relaxed": "Red channel, short text",
    "two_primary_amber_channels": "Two amber channels", "primary_red_single_channel_demoted": "Single red channel, demoted", "generic_aigt_red_single_channel": "Single red channel",
    "primary_amber_mixed_windowing": "Amber channel, mixed windows", "primary_amber_single_channel": "Amber channel", "multi_channel_convergence_mixed": "Convergence, mixed windows",
    "multi_channel_convergence": "Convergence of channels", "supporting_channel_amber": "Supporting channel", "yellow_signal_mixed_windowing": "Yellow signal, mixed windows", "yellow_signal": "Yellow signal",
    "obfuscation_delta": "Obfuscated text", "weak_signals_below_threshold": "Weak signals", "no_signal": "No signal",
}
BAR = 80
STYLE = (
    "body{font:14px sans-serif;max-width:60em;margin:2em auto}td,th{padding:.3em .8em;text-align:left}.bar{background:#888;height:8px;display:inline-block}"
    ".RED{color:#b00}.AMBER{color:#b60}.YELLOW{color:#880}.MIXED{color:#606}.GREEN{color:#080}.REVIEW{color:#555}mark{background:#fd6}.text{white-space:pre-wrap}"
)


def escaped(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def _label(value: Column, labels: dict[str, str]) -> Column:
    out = None
    for name, label in labels.items():
        out = F.when(value == name, label) if out is None else out.when(value == name, label)
    return out.otherwise(escaped(value))


def channel_rows(channels: Column, mode: Column, disabled: tuple[str, ...] = ()) -> Column:
    """One table row per channel: name, score as a bar, severity, role."""

    def row(c: Column) -> Column:
        role = F.when(c["channel"].isin(*disabled) if disabled else F.lit(False), "disabled").when(~c["data_sufficient"], "no data").when((mode == "task_prompt") & c["generic_only"], "supporting").otherwise("primary")
        bar = F.format_string('<span class="bar" style="width:%dpx"></span> %.2f', F.floor(c["score"] * BAR).cast("int"), c["score"])
        return F.concat(F.lit("<tr><td>"), _label(c["channel"], CHANNEL_LABELS), F.lit("</td><td>"), bar, F.lit('</td><td class="'), c["severity"], F.lit('">'), c["severity"], F.lit("</td><td>"), role, F.lit("</td></tr>"))

    return F.array_join(F.transform(channels, row), "\n")


def fusion_section(verdict: Column) -> Column:
    """What the verdict rests on: rule, mode, counts, short-text note."""
    item = lambda name, value: F.concat(F.lit(f"<li>{name}: "), value.cast("string"), F.lit("</li>"))
    return F.concat(
        F.lit("<h3>Basis</h3><p>"), _label(verdict["triggering_rule"], RULE_LABELS), F.lit("</p><p>"), escaped(verdict["reason"]), F.lit("</p><ul>"),
        item("Mode", verdict["mode"]), item("Primary red", verdict["n_primary_red"]), item("Primary amber and above", verdict["n_primary_amber"]),
        item("Yellow and above", verdict["n_yellow_plus"]), item("Red", verdict["n_red"]), F.lit("</ul>"),
        F.when(verdict["short_text_adjustment"], "<p>Short text: fewer than 100 words.</p>").otherwise(""),
    )


def single(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, html): the page of each scored row (columns channels, verdict), with its text highlighted."""
    v = F.col("verdict")
    head = F.concat(F.lit("<h2>"), escaped(F.col(key)), F.lit(': <span class="'), v["determination"], F.lit('">'), v["determination"], F.format_string("</span> (%.2f)</h2>", v["confidence"]))
    table = F.concat(F.lit("<table><tr><th>Channel</th><th>Score</th><th>Severity</th><th>Role</th></tr>"), channel_rows(F.col("channels"), v["mode"]), F.lit("</table>"))
    return df.select(F.col(key), F.concat(head, table, fusion_section(v), F.lit('<div class="text">'), residue_python.highlighted(F.coalesce(F.col(text_col), F.lit(""))), F.lit("</div>")).alias("html"))


def summary(df: DataFrame) -> DataFrame:
    """(html): one row, the table of verdicts of a batch."""
    counts = df.groupBy("verdict.determination").agg(F.count(F.lit(1)).alias("n"))
    # One line per kind of verdict.
    line = F.concat(F.lit("<tr><td>"), escaped(F.col("determination")), F.lit("</td><td>"), F.col("n").cast("string"), F.lit("</td></tr>"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("determination").alias("d"), line.alias("line")))), lambda x: x["line"])
    return counts.agg(F.concat(F.lit("<h1>Batch</h1><table><tr><th>Verdict</th><th>Rows</th></tr>"), F.array_join(lines, "\n"), F.lit("</table>")).alias("html"))


def write_html(df: DataFrame, path: str) -> None:
    """Pages (html) as text files, a page a line group, under a folder; each file opens with the style."""
    pages = df.select(F.concat(F.lit(f"<!doctype html><meta charset=\"utf-8\"><style>{STYLE}</style>"), F.col("html"), F.lit("<hr>")).alias("value"))
    pages.write.mode("overwrite").text(path)


def console(df: DataFrame, key: str) -> DataFrame:
    """(line): one printable line per scored row."""
    v = F.col("verdict")
    return df.select(F.format_string("%s  %-6s %.2f  %s", F.col(key).cast("string"), v["determination"], v["confidence"], v["reason"]).alias("line"))
