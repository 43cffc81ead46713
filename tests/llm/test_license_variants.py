"""Whole texts of common licenses, with and without title and appendix."""

from pathlib import Path

import pytest

from geoplane.llm import license_variants, licenses
from geoplane.llm.license_digests import DIGESTS
from geoplane.llm.license_texts import TEXTS

FOLDER = Path("/usr/share/common-licenses")


def scanned(spark, tmp_path, texts):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.license_id for r in licenses.op10_licenses(spark, str(tmp_path)).collect()}
    return [got[i] for i in range(len(texts))]


def test_short_licenses_without_title(spark, tmp_path):
    mit, isc, zlib = (TEXTS[k].split("\n", 1)[1] for k in ("MIT", "ISC", "Zlib"))
    three = TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE", license_variants.THIRD.format("copyright holder"), 1)
    texts = [mit, isc, zlib, three, TEXTS["MIT"], TEXTS["MIT notice"], "x " + mit, TEXTS["BSD-2-Clause"]]
    assert scanned(spark, tmp_path, texts) == ["MIT", "ISC", "Zlib", "BSD-3-Clause", "MIT", "MIT notice", None, "BSD-2-Clause"]


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the texts")
def test_common_licenses(spark, tmp_path):
    whole = {name: (FOLDER / name).read_text() for name in license_variants.FILES}
    apache, gpl = whole["Apache-2.0"], whole["GPL-3"]
    texts = [*whole.values(), apache[: apache.index("   APPENDIX")], gpl[gpl.index(" Copyright") : gpl.index("            How to Apply")], apache + " and more"]
    assert scanned(spark, tmp_path, texts) == [*(v[0] for v in license_variants.FILES.values()), "Apache-2.0", "GPL-3.0", None]
    found = {r.digest: r.license_id for r in licenses.known_digests(license_variants.variants(spark, str(FOLDER))).collect()}
    assert found == DIGESTS
