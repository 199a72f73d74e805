"""Direct reads of stored documents by request, and plans of insertions that a model proposes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.operators import folds


def pages(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_id, page, content, found) of every page that is asked for: ``requests`` has doc_id and ``pages`` (an array), ``stored`` doc_id, page, content.

    Numbers below 1 and repeats are left out; a page that isn't stored has ``found`` false. Null requests ask for nothing.
    """
    wanted = requests.select("doc_id", F.explode("pages").alias("page")).where("page > 0").distinct()
    there = stored.select("doc_id", "page", "content", F.lit(True).alias("found"))
    return wanted.join(there, ["doc_id", "page"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def metadata(requests: DataFrame, profiles: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(group_ref, entries, missing): the wanted fields of each group's documents as a JSON array in order of id, and the ids that are not there.

    ``requests``: group_ref and ``doc_ids`` (an array); ``profiles``: doc_id and the fields.
    """
    asked = requests.select("group_ref", F.explode(F.array_distinct("doc_ids")).alias("doc_id"))
    known = profiles.select("doc_id", F.struct(*fields).alias("_entry"))
    joined = asked.join(known, "doc_id", "left")
    # entries of one group are as many as its request names
    return joined.groupBy("group_ref").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.when(F.col("_entry").isNotNull(), F.struct("doc_id", "_entry")))), lambda e: e["_entry"])).alias("entries"),
        F.array_sort(F.collect_list(F.when(F.col("_entry").isNull(), F.col("doc_id")))).alias("missing"),
    )


def accepted_insertions(images: Sequence[str | None], sections: Sequence[str | None], topics: Sequence[str | None], valid: Sequence[bool]) -> list[bool]:
    """Which proposals stand, in their order: a known image not used before, a section without one so far, and a topic to stand behind."""
    used_images, used_sections, out = set(), set(), []
    for image, section, topic, known in zip(images, sections, topics, valid, strict=True):
        place = (section or "").strip()
        good = bool(known) and image not in used_images and place not in used_sections and bool((topic or "").strip())
        out.append(good)
        if good:
            used_images.add(image)
            used_sections.add(place)
    return out


def insertion_plan(proposals: DataFrame, candidates: DataFrame, report: str, order: str) -> DataFrame:
    """The proposals (report, order, image_id, section, topic) with ``accepted``; ``candidates``: report and the image_id of each usable image."""
    usable = candidates.select(report, "image_id").distinct().withColumn("_known", F.lit(True))
    judged = proposals.join(usable, [report, "image_id"], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    return folds.fold_column(judged, [report], [order], ["image_id", "section", "topic", "_known"], accepted_insertions, "accepted", T.BooleanType()).select(report, order, "image_id", "section", "accepted")
