"""Which lines count as program text."""

import pytest

from gridloom.llm.langid import prose_segments


@pytest.mark.parametrize(
    ("line", "left"),
    [
        ("WITH KIND REGARDS FROM THE TRIAL OFFICE", "with kind regards from the trial office"),
        ("Der Zähler wurde gestern im Keller abgelesen;", "der zähler wurde gestern im keller abgelesen"),
        ("Le relevé de la maison appelle total(x) avant chaque nuit", "le relevé de la maison appelle avant chaque nuit"),
        ("We keep every reading where kwh >= 3 and drop the others at night", "we keep every reading where and drop the others at night"),
    ],
)
def test_prose_beside_program_text_is_kept(line, left):
    assert [s for _, s in prose_segments(line)] == [left]


@pytest.mark.parametrize("line", ["WITH days AS (SELECT a FROM readings)", "SELECT household FROM readings", "UPDATE readings SET kwh = 3", "DELETE FROM readings", "total = sum(readings);", "def total(readings):", "if reading.kwh >= limit and not seen: print(reading)", "x.groupBy(day).agg(total(kwh)).where(total >= 3);", "| day | total | kwh |"])
def test_program_lines_are_dropped(line):
    assert prose_segments(line) == []


def test_long_tags_are_dropped_whole():
    tag = '<div class="' + "wort " * 100 + '">'
    assert len(tag) > 500 and [s for _, s in prose_segments(f"the meter was {tag}read on a cold morning</div>")] == ["the meter was read on a cold morning"]


def test_words_are_cleaned_alike_whether_kept_or_not():
    long = "x" * 50 + "12"
    assert prose_segments(f"the house {long} kept its meter") == prose_segments("the house  kept its meter")
