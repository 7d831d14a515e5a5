"""Licences of files: sparse TF-IDF cosine of lines, headers and whole texts to templates, and inheritance from the nearest directory."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolake.llm.common import materialize, small_side, text_class

# Notices by which licences are announced.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
}
# Fixed value: lines without any of these are no notices.
HINT = r"(?i)\b(?:licen[sc]ed?|licensing|released under|public domain|spdx-license-identifier)\b"
LEAST_COSINE = 0.6
LINE = "\n|(?<=[.!?]) (?=\\p{Lu})"

# Texts of licences, and the notices that stand at the head of files: named by licence, then what they are.
BODIES = {p.name.removesuffix(".txt"): p.read_text(encoding="utf-8") for p in sorted(
    (Path(__file__).parent / "license_texts").glob("*.txt"))}
_TOKEN = re.compile(r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+-])?")
_BREAK = re.compile(r"\n|(?<=[.!?]) (?=(.))")
_COMMENT = re.compile(r"(?:\s*(?:/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z)|(?:#|//|--|;|%|\*)[^\n]*))+", re.S)


def _of(name: str) -> str:
    return re.sub(r"\.(?:header|whole)$", "", name)


def tokens(line: Column) -> Column:
    """Lower-cased runs of letters, digits, dots, hyphens and pluses, without dots at the end."""
    return F.filter(F.transform(F.regexp_extract_all(F.lower(line), F.lit("([a-z0-9][a-z0-9.+-]*)"), F.lit(1)),
                                lambda t: F.regexp_replace(t, "[.]+$", "")), lambda t: t != "")


def _weighed(lines: DataFrame, df: DataFrame, total: int) -> DataFrame:
    """(line, token, w): unit-length TF-IDF vectors of lines."""
    tf = lines.select("line", F.explode(tokens(F.col("line"))).alias("token")).groupBy("line", "token").agg(
        F.count("*").alias("tf"))
    idf = F.log(F.lit(float(total + 1)) / (F.col("df") + 1)) + 1
    vector = tf.join(df, "token").select("line", "token", (F.col("tf") * idf).alias("w"))
    norm = vector.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return vector.join(norm, "line").select("line", "token", (F.col("w") / F.col("norm")).alias("w"))


def notices(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """(cls, at, license, cosine): the lines of each distinct text that match a template, ``at`` counting from 0.

    Document frequencies are counted over all candidate lines of all documents and
    the templates.  Each distinct line is compared once.
    """
    spark = docs.sparkSession
    lines = docs.filter(F.col("text").rlike(HINT)).select(
        text_class(F.col("text")).alias("cls"), F.posexplode(F.split("text", LINE)).alias("at", "line")).filter(
        F.col("line").rlike(HINT))
    lines = materialize(lines, "notice-lines")
    known = spark.createDataFrame([(k, t) for k, v in templates.items() for t in v], "license string, template string")
    counted = lines.groupBy("line").agg(F.count("*").alias("n")).unionByName(
        known.select(F.col("template").alias("line"), F.lit(1).cast("long").alias("n")))
    df = materialize(counted.select("n", F.explode(F.array_distinct(tokens(F.col("line")))).alias("token"))
                     .groupBy("token").agg(F.sum("n").alias("df")), "frequencies")
    total = counted.agg(F.sum("n")).first()[0]
    # Templates are a parameter: as many rows as it has words.
    of_templates = _weighed(known.select(F.col("template").alias("line")).distinct(), df, total).join(
        known, F.col("line") == F.col("template")).select("license", "template", "token", F.col("w").alias("v"))
    of_lines = _weighed(lines.select("line").distinct(), df, total)
    cosines = of_lines.join(F.broadcast(of_templates), "token").groupBy("line", "license", "template").agg(
        F.sum(F.col("w") * F.col("v")).alias("cosine"))
    best = cosines.filter(F.col("cosine") >= least).groupBy("line").agg(F.max_by(
        F.struct("license", F.round("cosine", 6).alias("cosine")), F.struct(
            F.round("cosine", 6), F.struct(F.length("license") * -1, "license"))).alias("b"))
    best = materialize(best.select("line", "b.license", "b.cosine"), "matched-lines")
    return lines.join(small_side(best, F.length("line") + 64), "line").select("cls", "at", "license", "cosine").distinct()


def _matcher(bodies: Mapping[str, str], least: float):
    """From a text to (licence, cosine, where its block ends) by the best template, or None.

    A token weighs 1 + log of its count, times log of the number of templates to
    that of those that hold it: what all licences say says nothing.
    """
    held = [Counter(_TOKEN.findall(t.lower())) for t in bodies.values()]
    df = Counter(t for h in held for t in h)
    number = {t: i for i, t in enumerate(sorted(df))}
    foreign = math.log(len(held) + 1)
    idf = np.array([math.log((len(held) + 1) / (df[t] + 1)) for t in number])
    known = np.zeros((len(held), len(number)))
    for row, h in zip(known, held):
        for t, n in h.items():
            row[number[t]] = (1 + math.log(n)) * idf[number[t]]
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    names = [_of(n) for n in bodies]
    sizes = sorted({n * part // 4 for h in held for n in [sum(h.values())] for part in (4, 5)})

    def of(text: str) -> tuple[str, float, int] | None:
        lowered = text.lower()
        found = list(_TOKEN.finditer(lowered))
        if not found:
            return None
        place: dict[str, int] = {}
        ids = np.array([number[t] if t in number else len(number) + place.setdefault(t, len(place)) for t in (
            m.group() for m in found)])
        if not (ids < len(number)).any():
            return None
        comment = _COMMENT.match(lowered)
        ends = {min(n, len(ids)) for n in sizes} | {len(ids)}
        if comment:
            ends.add(sum(m.end() <= comment.end() for m in found))
        best = None
        for end in sorted(ends - {0}):
            tf = np.bincount(ids[:end], minlength=len(number)).astype(np.float64)
            tf[tf > 0] = 1 + np.log(tf[tf > 0])
            own, rest = tf[:len(number)] * idf, tf[len(number):] * foreign
            norm = math.sqrt(own @ own + rest @ rest)
            if norm:
                cosines = known @ own / norm
                i = int(cosines.argmax())
                if cosines[i] >= least and (best is None or cosines[i] > best[1]):
                    best = names[i], float(cosines[i]), len(text) if end == len(ids) else found[end - 1].end()
        return best

    return of


def bodies_of(docs: DataFrame, bodies: Mapping[str, str] = BODIES, least: float = LEAST_COSINE) -> DataFrame:
    """(cls, license, cosine, until): texts that open with a licence or its header, or are one; ``until`` is the first line after it.

    Compared with each template are the text's opening of as many words as the
    template has, and of a quarter more, for lines before it; the comment the text
    opens with; and the whole text.  The most similar template counts.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _matcher(bodies, least)
        for batch in batches:
            out = []
            for i, text in enumerate(batch["text"].to_pylist()):
                best = of(text)
                if best:
                    breaks = sum(m.group(1) is None or unicodedata.category(m.group(1)) == "Lu"
                                 for m in _BREAK.finditer(text) if m.start() < best[2])
                    out.append((i, best[0], round(best[1], 6), breaks + 1))
            yield pa.RecordBatch.from_arrays([
                batch["cls"].take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.string()),
                pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.int32())],
                names=["cls", "license", "cosine", "until"])

    cls = text_class(F.col("text"))
    rows = docs.filter("text is not null").select(cls.alias("cls"), "text")
    return rows.mapInArrow(run, f"cls {_type(rows)}, license string, cosine double, until int").distinct()


def _type(rows: DataFrame) -> str:
    return rows.schema["cls"].dataType.simpleString()


def scan(files: DataFrame, *, file_id: str = "doc_id", path: str = "path", is_license_file: Column | None = None,
         templates: Mapping[str, tuple[str, ...]] = TEMPLATES, bodies: Mapping[str, str] = BODIES,
         least: float = LEAST_COSINE) -> DataFrame:
    """(doc_id, directory, licenses, license, origin) per file.

    ``licenses`` are all licences whose notices a file holds, sorted.  A notice is a
    line that announces a licence, or the licence's text or header that a file opens
    with or consists of; lines within such a text are no notices of their own.  ``license`` is
    that of its first notice (``origin`` header).  A file without one inherits from
    the nearest directory above it that has a licence file with a notice (``origin``
    directory): the most frequent first notice of that directory's licence files,
    the first by name of equally frequent ones.  Else both are null.  By default a
    licence file is one whose name begins with license, licence, copying or notice.

    Null texts have no notices; files with a null path or none above them inherit
    nothing; an empty table gives no rows; repeated rows are kept; other columns
    are ignored.
    """
    named = F.lower(F.element_at(F.split("path", "/"), -1)).rlike("^(licen[sc]e|copying|notice)")
    rows = files.select(F.col(file_id).alias("doc_id"), "text", F.col(path).alias("path"),
                        (is_license_file if is_license_file is not None else F.lit(None).cast("boolean")).alias("given"))
    rows = rows.withColumn("holds", F.coalesce("given", named, F.lit(False)) if is_license_file is not None else F.coalesce(
        named, F.lit(False)))
    texts = materialize(bodies_of(rows, bodies, least), "licence-texts")
    lines = notices(rows, templates, least)
    inside = small_side(texts.select(F.col("cls").alias("c"), "until"), F.lit(40))
    found = lines.join(inside, F.col("cls") == F.col("c"), "left").filter("until is null or at >= until").select(
        "cls", "at", "license").unionByName(texts.select("cls", F.lit(0).alias("at"), "license"))
    held = materialize(found.groupBy("cls").agg(
        F.sort_array(F.collect_set("license")).alias("licenses"), F.min_by("license", F.struct("at", "license")).alias("first"),
        F.min("at").alias("at")), "held")
    parents = F.split("path", "/")
    directory = F.when(F.size(parents) > 1, F.array_join(F.slice(parents, 1, F.size(parents) - 1), "/")).otherwise(
        F.when(F.col("path").isNotNull(), F.lit("")))
    own = rows.select("doc_id", "holds", directory.alias("directory"), text_class(F.col("text")).alias("own")).join(
        small_side(held, F.lit(160)), F.col("own") == F.col("cls"), "left").select(
        "doc_id", "directory", "holds", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), "first")
    own = materialize(own, "owned")
    counts = own.filter("holds and first is not null and directory is not null").groupBy("directory", "first").agg(
        F.count("*").alias("n"))
    ranked = Window.partitionBy("directory").orderBy(F.col("n").desc(), "first")
    given = counts.withColumn("r", F.row_number().over(ranked)).filter("r = 1").select(
        F.col("directory").alias("above"), F.col("first").alias("inherited"))
    # Inheritance is settled once per directory: each joins the directories above it, itself included.
    steps = F.split("directory", "/")
    above = own.filter("directory is not null").select("directory").distinct().withColumn("above", F.explode(F.concat(
        F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")),
        F.array(F.lit(""))))).distinct()
    nearest = materialize(above.join(given, "above").groupBy("directory").agg(
        F.max_by("inherited", F.length("above")).alias("inherited")), "inherited")
    side = small_side(nearest.withColumnRenamed("directory", "d"), F.length("d") + 64)
    return own.join(side, F.col("directory") == F.col("d"), "left").select(
        "doc_id", "directory", "licenses", F.coalesce("first", "inherited").alias("license"),
        F.when(F.col("first").isNotNull(), "header").when(F.col("inherited").isNotNull(), "directory").alias("origin"))
