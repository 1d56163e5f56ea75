"""Choosing one address out of a source list."""

from __future__ import annotations

from pageloom.functions import pattern


def leading_number(value: str) -> str:
    """``800w`` gives 800, ``2x`` gives 2, text gives null."""
    return f"try_cast(regexp_extract({value}, {pattern(r'^\s*([+-]?\d+)')}, 1) as double)"


def usable(sources: str) -> str:
    """True for an address list that is neither missing, empty nor inline data."""
    return f"coalesce({sources} != '' and not startswith({sources}, 'data:'), false)"


def best_candidate(sources: str) -> str:
    """Best entry of a comma separated list, null when every entry is skipped.

    The first entry without a numeric descriptor wins at once; else the largest number does, the later
    one on a tie. Playlists and negative numbers never win.
    """
    blank = pattern(r"^\s+|\s+$")
    entries = (
        f"filter(transform(split({sources}, ','), s -> regexp_replace(s, {blank}, '')),"
        " s -> not contains(s, '.m3u8'))"
    )
    size = f"case when contains(s, ' ') then {leading_number("regexp_extract(s, '^[^ ]* (.*)$', 1)")} end"
    sized = (
        f"transform({entries}, (s, i) -> named_struct('size', {size}, 'no', i, 'url', regexp_extract(s, '^([^ ]*)', 1)))"
    )
    winner = (
        "coalesce(try_element_at(filter(es, e -> e.size is null), 1).url,"
        " array_max(filter(es, e -> e.size >= 0)).url)"
    )
    return f"transform(array({sized}), es -> {winner})[0]"
