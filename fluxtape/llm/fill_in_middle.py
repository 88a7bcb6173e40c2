"""Fill-in-middle by escaped markers, with string functions of columns only.

A mark that no text can hold any more, because the mark and the escape character are
escaped first, is appended after every unit.  How often it was appended is the number
of units, and ``substring_index`` on the mark cuts the units before, between and after
two ranks that a hash of the doc_id draws.  The parts lose the mark, are unescaped and
put between sentinels.  Texts are never split into arrays, so a very long one costs a
few copies of itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The mark after each unit, and the character that escapes both.
MARK, ESCAPE = "\x01", "\x02"
#: A line with its end, or the last line without one.
LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "2")), F.lit(MARK), F.lit(ESCAPE + "1"))


def _plain(part: Column) -> Column:
    """A cut part without its marks, as it was in the text."""
    return F.replace(F.replace(F.replace(part, F.lit(MARK), F.lit("")), F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "2"), F.lit(ESCAPE))


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that cannot arise where texts and sentinels meet: their first character is nowhere else in them."""
    if len(set(sentinels)) < 3 or any(not s or s[0] in t[1:] for s in sentinels for t in sentinels):
        raise ValueError("sentinels must differ, and no first character of one may occur later in any of them")
    return sentinels


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that a transformed one came from, by its output and form alone."""
    p, s, m = _checked(sentinels)
    body = lambda first: F.substr(output, F.lit(len(first) + 1))
    middle = F.substring_index(output, m, -1)
    psm = F.substring_index(body(p), m, 1)
    spm = F.substring_index(body(s), m, 1)
    return (
        F.when(form == "psm", F.concat(F.substring_index(psm, s, 1), middle, F.substring_index(psm, s, -1)))
        .when(form == "spm", F.concat(F.substring_index(spm, p, -1), middle, F.substring_index(spm, p, 1)))
        .otherwise(output)
    )


def fill_in_middle(docs: DataFrame, units: str = LINES, sentinels: tuple[str, str, str] = SENTINELS, seed: str = "7", rate: int = 100, spm: int = 50) -> DataFrame:
    """``doc`` (the row), ``n`` units, ``form``, ``prefix``, ``middle``, ``suffix``, ``output`` and ``restored``.

    Four numbers of 32 bits from the SHA-256 of seed, ``:`` and doc_id draw two cuts, whether
    the text is transformed (``rate`` in 100) and whether its suffix comes first (``spm`` in 100).
    ``units`` is a pattern that matches no empty string; what it does not match stays at the front
    of the unit after it.  Texts that are empty, hold a sentinel or are not drawn keep the form ``plain``,
    and their parts are null.  A null text counts as empty, a null doc_id is hashed as nothing,
    repeated rows give repeated results, an empty table gives none, and other columns are only
    carried in ``doc``, so their names cannot clash.
    """
    p, s, m = _checked(sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    rows = rows.withColumn("escaped", _escaped(F.col("text")))
    rows = rows.withColumn("marked", F.regexp_replace("escaped", units, f"$0{MARK}"))
    rows = rows.withColumn("n", (F.length("marked") - F.length("escaped")).cast("bigint"))
    cuts = [h[i] % (F.col("n") + 1) for i in (0, 1)]
    kept = (F.col("n") == 0) | (F.col("text") == "") | F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m)) | (h[2] % 100 >= rate)
    rows = rows.select("*", F.least(*cuts).cast("int").alias("lo"), F.greatest(*cuts).cast("int").alias("hi"), F.when(kept, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm").alias("form"))
    drawn = lambda sql: F.when(F.col("form") != "plain", _plain(F.expr(sql)))
    mark = f"'{MARK}'"
    rows = rows.select(
        "doc",
        "text",
        "n",
        "form",
        drawn(f"substring_index(marked, {mark}, lo)").alias("prefix"),
        drawn(f"substring_index(substring_index(marked, {mark}, hi), {mark}, lo - hi)").alias("middle"),
        drawn(f"substring_index(marked, {mark}, cast(hi - n - 1 as int))").alias("suffix"),  # the last mark ends the text
    )
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle"))
        .otherwise(F.col("text"))
    )
    rows = rows.select("doc", "n", "form", "prefix", "middle", "suffix", output.alias("output"))
    return rows.withColumn("restored", restored(F.col("output"), F.col("form"), sentinels))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u,
    list_transform(range(4), lambda i: CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT)) AS h FROM t
), c AS (
  SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS lo, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
      WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(list_slice(u, 1, lo), ''), '') AS p,
    coalesce(array_to_string(list_slice(u, lo + 1, hi), ''), '') AS m, coalesce(array_to_string(list_slice(u, hi + 1, n), ''), '') AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
