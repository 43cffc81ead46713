"""Whole texts that common licenses are given as: with and without title and appendix, wrapped and as one line a paragraph."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .license_texts import TEXTS

#: As Debian keeps them. For each file: its license, where its text can begin besides the top, where it can end besides the bottom.
_GNU = [r"(?m)^ *Copyright \(C\)"], [r"END OF TERMS AND CONDITIONS\s", r"(Appendix: |ADDENDUM: )?How to (Apply These|use this)"]
FILES = {
    "Apache-2.0": ("Apache-2.0", ["TERMS AND CONDITIONS FOR USE"], ["END OF TERMS AND CONDITIONS", "APPENDIX: How to apply"]),
    "Artistic": ("Artistic-1.0-Perl", ["Preamble"], ["The End"]),
    "BSD": ("BSD-3-Clause", ["Redistribution and use"], []),
    "CC0-1.0": ("CC0-1.0", ["CC0 1.0 Universal", "CREATIVE COMMONS CORPORATION IS", "Statement of Purpose"], []),
    "GFDL-1.2": ("GFDL-1.2", *_GNU), "GFDL-1.3": ("GFDL-1.3", *_GNU),
    "GPL-1": ("GPL-1.0", *_GNU), "GPL-2": ("GPL-2.0", *_GNU), "GPL-3": ("GPL-3.0", *_GNU),
    "LGPL-2": ("LGPL-2.0", *_GNU), "LGPL-2.1": ("LGPL-2.1", *_GNU), "LGPL-3": ("LGPL-3.0", *_GNU),
    "MPL-1.1": ("MPL-1.1", [r"1\. Definitions"], [r"EXHIBIT A"]),
    "MPL-2.0": ("MPL-2.0", [r"1\. Definitions"], ["Exhibit A - Source"]),
}
TITLES = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("", "ISC License", "The ISC License"),
    "Zlib": ("", "zlib License", "The zlib License"), "BSD-2-Clause": ("", "BSD 2-Clause License", "The BSD 2-Clause License"),
    "BSD-3-Clause": ("", "BSD 3-Clause License", "The BSD 3-Clause License"), "Unlicense": ("", "The Unlicense"),
}
THIRD = """3. Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE"""


def _wraps(text: str) -> Iterator[str]:
    yield text
    yield "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text))


def file_variants(name: str, text: str) -> Iterator[tuple[str, str]]:
    """(license_id, text) of the forms of one file of ``FILES``."""
    license_id, starts, ends = FILES[name]
    begin = [0, *(re.search(s, text).start() for s in starts)]
    end = [len(text), *(list(re.finditer(e, text))[-1].start() for e in ends if re.search(e, text))]
    end += [m.end() for m in re.finditer("END OF TERMS AND CONDITIONS|The End", text)]
    for a, b in product(begin, end):
        for form in _wraps(text[a:b]):
            yield license_id, form


def short_variants() -> Iterator[tuple[str, str]]:
    """(license_id, text) of the licenses that are short, under each of their titles; lists with numbers and with other marks."""
    bsd = TEXTS["BSD-2-Clause"]
    bodies = {k: [v.removeprefix(TITLES[k][1]).strip()] for k, v in TEXTS.items() if k in TITLES}
    bodies["BSD-3-Clause"] = [bsd.replace("THIS SOFTWARE", THIRD.format(who), 1) for who in ("copyright holder", "<owner>", "<organization>")]
    for license_id, texts in bodies.items():
        for text, title in product(texts, TITLES[license_id]):
            yield license_id, f"{title}\n\n{text}"
            yield license_id, f"{title}\n\n" + re.sub(r"(?m)^\d\. ", "* ", text)


def variants(spark: SparkSession, folder: str) -> DataFrame:
    """(license_id, text) of all forms; the long licenses are read from ``folder``. ``license_digests`` keeps their digests."""
    rows = [*short_variants(), *(v for name in FILES for v in file_variants(name, Path(folder, name).read_text()))]
    return spark.createDataFrame(rows, "license_id string, text string")
