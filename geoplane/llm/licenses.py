"""License scans: whole texts in canonical form, looked up by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, saved, table
from .license_digests import DIGESTS
from .license_texts import TEXTS

COPYRIGHT = r"(?m)^[ \t]*(copyright|copr\.|\(c\)|©|all rights reserved)[^\n]*$"
#: Punctuation and white space of ASCII, and the marks that word processors put for them.
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F©®™‘’“”«»–—•·… ]+"
#: Spellings that mean the same in a license, after case and punctuation.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licencing", "licensing"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("authorised", "authorized"),
    ("favour", "favor"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("https", "http"),
)


#: Canonical texts that have any of the spellings to be replaced.
UNUSUAL = f" ({'|'.join(one for one, _ in SPELLINGS)}) "


def canonical(text):
    """Column: lower case (A-Z), no copyright lines, no punctuation, one spelling, one space between words."""
    text = F.translate(F.coalesce(text, F.lit("")), UPPER + "\r", LOWER + "\n")
    text = F.regexp_replace(F.regexp_replace(text, COPYRIGHT, " "), PUNCTUATION, " ")
    text = F.concat(F.lit(" "), F.trim(text), F.lit(" "))
    usual = F.replace(text, F.lit(" "), F.lit("  "))  # words next to each other share no space then
    for one, other in SPELLINGS:
        one, other = (f" {x.replace(' ', '  ')} " for x in (one, other))
        usual = F.replace(usual, F.lit(one), F.lit(other))
    return F.trim(F.when(text.rlike(UNUSUAL), F.regexp_replace(usual, " +", " ")).otherwise(text))


def known_digests(licenses: DataFrame) -> DataFrame:
    """(digest, license_id) of licenses (license_id, text); of texts that are alike the least license_id."""
    found = licenses.select("license_id", canonical(F.col("text")).alias("c")).filter("c <> '' and license_id is not null")
    return found.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license_id) of each row of ``docs``: the license whose text is its whole text, else null.

    A text that is null, or that has nothing left in canonical form, has a null digest and matches nothing. Repeated
    rows give repeated rows. Only digests are joined. The known ones are written first, so that Spark broadcasts them
    only if they are within spark.sql.autoBroadcastJoinThreshold. ``digests`` (digest, license_id) are known besides.
    """
    known = known_digests(licenses)
    if digests is not None:
        known = known.unionByName(digests).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    known = saved(known, "digests")
    digest = F.when(F.col("c") != "", F.sha2("c", 256)).alias("digest")
    return docs.select("doc_id", canonical(F.col("text")).alias("c")).select("doc_id", digest).join(known, "digest", "left").select("doc_id", "digest", "license_id")


def known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEXTS.items()), "license_id string, text string")


def common(spark: SparkSession) -> DataFrame:
    """(digest, license_id) of the forms that common licenses are given as, see ``license_variants``."""
    return spark.createDataFrame(list(DIGESTS.items()), "digest string, license_id string")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known(spark), common(spark))


def forms(licenses: DataFrame) -> DataFrame:
    """(doc_id, text) of licenses (license_id, text): texts as they are found, written in other ways, and with a word more."""
    t = F.col("text")
    found = (
        t, F.upper(t), F.replace(t, F.lit("\n"), F.lit("\r\n")), F.concat(F.lit("Copyright 2020 A. Person\n"), t), F.replace(t, F.lit("."), F.lit(" . ")),
        F.concat(t, F.lit(" and more")),
    )
    return licenses.select(F.posexplode(F.array(*found)).alias("form", "text"), "license_id").select(F.concat_ws("/", "license_id", F.col("form").cast("string")).alias("doc_id"), "text")


def license_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan over the known texts themselves, in several forms: what whole license texts give (``documents`` has few or none)."""
    return scan(forms(known(spark)), known(spark), common(spark))


def _sql(text: str) -> str:
    text = f"translate(coalesce({text}, ''), '{UPPER}' || chr(13), '{LOWER}' || chr(10))"
    text = f"regexp_replace(regexp_replace({text}, '{COPYRIGHT}', ' ', 'g'), '{PUNCTUATION}', ' ', 'g')"
    text = f"replace(' ' || trim({text}) || ' ', ' ', '  ')"
    for one, other in SPELLINGS:
        one, other = (f" {x.replace(' ', '  ')} " for x in (one, other))
        text = f"replace({text}, '{one}', '{other}')"
    return f"trim(regexp_replace({text}, ' +', ' ', 'g'))"


_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_TEXTS = f"(values {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in TEXTS.items())}) as v(license_id, text)"
_KNOWN = f"""texts as (select * from {_TEXTS}), known as (
  select digest, min(license_id) as license_id from (
    select sha256(c) as digest, license_id from (select license_id, {_sql("text")} as c from texts) where c <> ''
    union all select * from (values {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in DIGESTS.items())})
  ) group by 1
)"""
_SCAN = f"""select doc_id, digest, license_id
from (select doc_id, case when c <> '' then sha256(c) end as digest from (select doc_id, {_sql("text")} as c from documents)) left join known using (digest)"""
SQL = f"with {_KNOWN} {_SCAN}"
FORMS_SQL = f"""with {_KNOWN}, forms as (
  select license_id || '/' || form as doc_id, case form when 0 then text when 1 then upper(text) when 2 then replace(text, chr(10), chr(13) || chr(10))
    when 3 then 'Copyright 2020 A. Person' || chr(10) || text when 4 then replace(text, '.', ' . ') else text || ' and more' end as text
  from texts, range(6) as r(form)
) {_SCAN.replace("from documents", "from forms")}"""
