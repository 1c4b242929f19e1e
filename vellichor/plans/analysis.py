"""The analysis of a corpus as one chain of transforms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.operators import attribution, colors, segment, speech, stats
from vellichor.session import staged


@dataclass
class Analysis:
    """Tables of an analysed corpus. attributed is written once: everything else is a view on it."""

    blocks: DataFrame
    sentences: DataFrame
    attributed: DataFrame
    cast: DataFrame

    def stats(self) -> DataFrame:
        return stats.book_stats(self.blocks, self.sentences.groupBy("book_id").agg(F.count("*").alias("sentences")), self.attributed)

    def slots(self) -> DataFrame:
        return colors.global_slots(self.cast)

    def chapter_slots(self) -> DataFrame:
        return colors.chapter_slots(self.attributed.filter("not inner"), self.slots())


def analyse(blocks: DataFrame) -> Analysis:
    """Blocks -> sentences -> speech -> speakers -> merged cast. One exchange by book, before the ordered pass."""
    spans = speech.speech_spans(blocks)
    attributed, cast = attribution.merged_cast(staged(attribution.attribute(blocks, spans)), blocks)
    return Analysis(blocks, segment.sentences(blocks), attributed, cast)
