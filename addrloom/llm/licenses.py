"""License scans by canonical digest, with DataFrame functions only.

An entire text is brought to a canonical form (case, copyright lines, spelling,
punctuation) and its digest is joined to the digests of known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import LICENSES, all_texts

#: Equivalent spellings, as (pattern, replacement) on lower-case text; both sides of the join pass them.
SPELLINGS = (
    (r"(licen|practi|offen|defen)ce", "$1se"),
    (r"is(e[drs]?|ing|ations?)([^\p{L}]|$)", "iz$1$2"),
    (r"(lab|fav|col|hon|behavi)our", "$1or"),
    (r"sub-licens", "sublicens"),
    (r"non-commercial", "noncommercial"),
    (r"copyright owner", "copyright holder"),
    (r"acknowledgement", "acknowledgment"),
    (r"judgement", "judgment"),
    (r"whilst", "while"),
    (r"https:", "http:"),
)
#: Line ends that become line feeds first, so that both engines see the same lines.
LINE_END = r"\r\n?|[\x{85}\x{2028}\x{2029}]"
#: "copyright" before a word of a licence's body is no statement of a holder: it is marked before statements go, and restored after.
BODY = r"copyright([ \t]+(?:notice|holder|owner|law|licen|interest|right|statement|claim|treat|protect|infring|permission|disclaim|status|management|doctrine|applies|resulting|means|(?:and|or|on|to|in|is|for|of|this|the|as|has|with|by the)(?:[^a-z]|$)))"
#: How the text goes on after a statement on the same line.
OPENINGS = r"all rights reserved|permission is hereby|permission to use|redistribution and use|this software is|this program|this library|everyone is permitted|licen[sc]ed under|released under|this work is|this is free|the mit license|mit license|gnomovision"
#: A statement of a holder up to such an opening or the end of the line.
STATEMENT = r"(?m)(?:^[^\p{L}\p{N}\n]*copyright[ \t]+[^\s]|copyright[^\p{L}\p{N}\n]*(?:\(c\)|©|[0-9]{4}|<year)|\(c\)[^\p{L}\p{N}\n]*(?:copyright|[0-9]{4})|©)[^\n]{0,200}?(" + OPENINGS + "|$)"
RESERVED = "all rights reserved"
_MARK = "\x01"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: The known table is broadcast only up to this many rows; above it the join shuffles.
BROADCAST_ROWS = 10_000


def canonical(text: Column) -> Column:
    """Lower case without statements of holders, in one spelling, words parted by one space.

    Lines of a licence that begin with "copyright" stay, and so does what follows a statement on its line.
    """
    out = F.regexp_replace(F.lower(text), LINE_END, "\n")
    out = F.regexp_replace(out, BODY, f"copy{_MARK}right$1")
    out = F.replace(F.regexp_replace(out, STATEMENT, " $1"), F.lit(_MARK), F.lit(""))
    out = F.replace(out, F.lit(RESERVED), F.lit(" "))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to) if "(" in pattern else F.replace(out, F.lit(pattern), F.lit(to))
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark, texts=LICENSES) -> DataFrame:
    """(digest, license_id) of (licence, text) pairs; the first name in order of texts that come out alike."""
    rows = spark.createDataFrame(list(texts), "license_id string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id for every row; license_id is null where the text is no known licence.

    ``texts`` are all known ones by default. Null and empty texts, and texts
    without a letter or digit, have the digest of the empty text, which is no
    licence. Repeated rows each get their answer. Other columns are not returned.
    """
    texts = all_texts() if texts is None else texts
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("digest"))
    table = known(docs.sparkSession, texts).where(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256))
    return rows.join(F.broadcast(table) if len(texts) <= BROADCAST_ROWS else table, "digest", "left").select("doc_id", "digest", "license_id")


def _sql_digest(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{LINE_END}', chr(10), 'g')"
    out = f"regexp_replace({out}, '{BODY}', 'copy' || chr(1) || 'right\\1', 'g')"
    out = f"replace(regexp_replace({out}, '{STATEMENT}', ' \\1', 'g'), chr(1), '')"
    out = f"replace({out}, '{RESERVED}', ' ')"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"sha256(trim(regexp_replace({out}, '{NOT_WORD}', ' ', 'g')))"


def sql(texts=None) -> str:
    """The scan in DuckDB SQL, with all known texts by default."""
    values = ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in pair)) for pair in (all_texts() if texts is None else texts))
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT {_sql_digest("text")} AS digest, license_id FROM (VALUES {values}) AS v(license_id, text)) GROUP BY digest
), scanned AS (
  SELECT doc_id, {_sql_digest("coalesce(text, '')")} AS digest FROM documents
)
SELECT s.doc_id, s.digest, k.license_id FROM scanned s LEFT JOIN known k ON k.digest = s.digest AND k.digest <> sha256('')
"""
