"""The finding codes, each with its severity and a one-line meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("error", "warn", "info")

# The codes and severities of the manifest; the meanings are our own words.
MANIFEST = {
    "asset-outside-root": ("warn", "a reference leaves the folder of its document"),
    "asset-overwrites-document": ("warn", "a reference has the name of the document itself"),
    "audit-failed": ("warn", "the checks did not run"),
    "audit-partial": ("warn", "the checks stopped part way"),
    "canvas-fallback-unnamed": ("warn", "a canvas holds fallback content without a name"),
    "canvas-unpainted": ("warn", "a named canvas paints nothing"),
    "content-overflows-page": ("warn", "an element is wider than the printable area"),
    "content-unreadable": ("error", "a content cannot be decoded"),
    "dialog-dismissed": ("warn", "a dialog was refused"),
    "empty-alt": ("warn", "an image has an empty description and is not decorative"),
    "encrypted-document": ("error", "the document is encrypted"),
    "figure-role-corrected": ("info", "a grouping figure around a described figure was re-tagged"),
    "figure-uncaptioned": ("warn", "a figure has neither caption nor described image"),
    "font-fallback": ("warn", "a family is asked for that is not loaded"),
    "font-metrics": ("warn", "a metric is negative and has no source"),
    "form-fields-static": ("warn", "form controls print as drawings"),
    "glyphs-skipped": ("info", "further characters without glyph are invisible"),
    "image-downsampled": ("info", "an image exceeds the resolution cap"),
    "js-error": ("warn", "a script error was not caught"),
    "json-rendered": ("error", "a data file stands in place of a document"),
    "lang-undeclared": ("warn", "the document declares no language"),
    "ligature-spans": ("info", "redundant text spans were removed"),
    "link-descriptions-skipped": ("warn", "links and descriptions do not pair one for one"),
    "list-bodied": ("info", "list items were given a body"),
    "margin-ignored": ("warn", "the requested margin gives way to the declared one"),
    "metadata-authored": ("info", "the author was taken from the document"),
    "metadata-subject": ("info", "the subject was taken from the document"),
    "missing-alt": ("warn", "an image has no description"),
    "missing-glyph": ("warn", "a character is in no font"),
    "network-blocked": ("warn", "a remote request was blocked"),
    "not-a-pdf": ("error", "the required header is missing"),
    "orientation-ignored": ("error", "the declared paper cannot be turned"),
    "orientation-overridden": ("info", "the declared paper was turned"),
    "output-unverified": ("error", "the result failed the structural check"),
    "page-probe-failed": ("warn", "a probe failed, its measurement is missing"),
    "page-size-override": ("info", "the requested paper replaces the declared one"),
    "repair-rejected": ("warn", "a rewrite did not verify and was dropped"),
    "role-mapped": ("info", "non-standard roles were mapped to standard ones"),
    "role-retagged": ("info", "containers were given their roles"),
    "rtl-digit-run": ("warn", "a number is reversed in right-to-left text"),
    "rtl-page-counter": ("warn", "a page counter is laid out right-to-left"),
    "scripts-disabled": ("warn", "scripts did not run"),
    "select-untagged": ("warn", "select elements print without a tag"),
    "selection-fragmented": ("warn", "gaps break the text selection"),
    "structure-ghost-mcid": ("warn", "the structure names a block that is not there"),
    "structure-orphan-mcid": ("warn", "a block is named by no structure"),
    "stylesheet-unreadable": ("warn", "a style sheet could not be read"),
    "subresource-failed": ("warn", "a referenced asset did not load"),
    "text-runs-merged": ("info", "text runs were merged"),
    "unfilled-placeholder": ("error", "a template placeholder is not filled"),
    "unsupported-paged-media": ("error", "a paged-media function is not supported"),
    "untagged-document": ("info", "the document has no structure"),
    "url-render-blocked": ("error", "a remote address needs permission"),
}


def manifest(spark: SparkSession, severity: str | None = None) -> DataFrame:
    """The codes as a table, or those of one severity; the table is fixed and small."""
    if severity is not None and severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity!r}; known: {', '.join(SEVERITIES)}")
    rows = [(code, s, text) for code, (s, text) in sorted(MANIFEST.items())]
    df = spark.createDataFrame(rows, "code string, severity string, summary string")
    return df if severity is None else df.filter(F.col("severity") == severity)
