"""Choosing the source of a picture or video from its children."""

from __future__ import annotations

from collections.abc import Sequence

from pageloom.functions import let, text_array
from pageloom.functions.markup import attr, parse_attrs
from pageloom.functions.srcset import best_candidate, usable


def media_choice(kids: str, picture: bool, priority: Sequence[str] = ()) -> str:
    """``struct<src, alt>`` chosen by folding over the element children in order; null for no choice.

    A usable image of a picture ends the search. A source is taken while nothing is chosen, or when its
    type ranks before the chosen one; a type that is not listed ranks first of all. Any other element
    cancels the choice.
    """
    rank = f"cast(array_position({text_array(priority)}, coalesce({attr('ka', 'type')}, '')) as int) - 1"
    fields = (
        f"named_struct('tag', k.tag, 'src', {attr('ka', 'src')}, 'srcset', {attr('ka', 'srcset')},"
        f" 'late', {attr('ka', 'data-srcset')}, 'alt', coalesce({attr('ka', 'alt')}, ''), 'rank', {rank})"
    )
    parsed = f"transform({kids}, k -> {let(parse_attrs('k.tok', 'k.tag'), 'ka', fields)})"
    state = (
        "named_struct('src', {src}, 'rank', {rank}, 'alt', {alt}, 'done', {done}, 'dead', {dead})"
    )
    start = state.format(src="cast(null as string)", rank="-1", alt="cast(null as string)", done="false", dead="false")
    sources = f"case when {usable('c.src')} then c.src when {usable('c.srcset')} then c.srcset when {usable('c.late')} then c.late end"
    has_any = "(coalesce(c.src, '') != '' or coalesce(c.srcset, '') != '' or coalesce(c.late, '') != '')"
    taken = state.format(
        src=f"coalesce({best_candidate(sources)}, s.src)", rank="c.rank", alt="s.alt", done="false", dead="false"
    )
    image = state.format(
        src=f"if({usable('c.src')}, c.src, s.src)", rank="s.rank", alt="c.alt", done=usable("c.src"), dead="false"
    )
    dead = state.format(src="s.src", rank="s.rank", alt="s.alt", done="false", dead="true")
    image_case = f"when c.tag = 'img' then {image}" if picture else ""
    step = (
        f"case when s.done or s.dead then s {image_case}"
        f" when c.tag = 'source' then if(({has_any} and coalesce(s.src, '') = '') or c.rank < s.rank, {taken}, s)"
        f" else {dead} end"
    )
    end = "if(s.dead or coalesce(s.src, '') = '', null, named_struct('src', s.src, 'alt', s.alt))"
    return f"aggregate({parsed}, {start}, (s, c) -> {step}, s -> {end})"
