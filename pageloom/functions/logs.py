"""Expressions over download log lines and format texts."""

from __future__ import annotations

from pageloom.functions import pattern, text
from pageloom.functions.vocab import FORMAT_MISSING_TEXT

# Fixed value: the pattern of a progress line.
PROGRESS = pattern(r"\[download\] *(.*) of *([^ ]*)(:? *at *([^ ]*))?(:? *ETA *([^ ]*))?")
# Fixed value: a size or speed with a decimal point and a binary unit.
SIZE = pattern(r"([0-9]+\.[0-9]+)([KMG]iB)")


def progress(line: str) -> str:
    """Percent, total size, speed and remaining time of a progress line; null for other lines."""
    number = pattern(r"^\s*([+-]?[0-9]+\.?[0-9]*)")
    percent = f"try_cast(regexp_extract(replace(regexp_extract({line}, {PROGRESS}, 1), '%', ''), {number}, 1) as double)"
    return (
        f"case when startswith({line}, '[') and {line} rlike {PROGRESS} then named_struct('percent', {percent},"
        f" 'total_size', replace(regexp_extract({line}, {PROGRESS}, 2), '~', ''),"
        f" 'speed', nullif(regexp_extract({line}, {PROGRESS}, 4), ''),"
        f" 'eta', nullif(regexp_extract({line}, {PROGRESS}, 6), '')) end"
    )


def event_type(line: str) -> str:
    """First word of a bracketed line without its brackets; null for other lines."""
    word = f"substring(regexp_extract({line}, '^([^ ]*)', 1), 2)"
    return f"case when startswith({line}, '[') then regexp_replace({word}, {pattern(r'^([^\]]*)\]')}, '$1') end"


def event_data(line: str) -> str:
    """The line from its first space on; all of it when there is none."""
    return (
        f"case when startswith({line}, '[') then"
        f" case when instr({line}, ' ') = 0 then {line} else substring({line}, instr({line}, ' ')) end end"
    )


def size_mib(line: str) -> str:
    """First size in the text in MiB, from its integer part only; null when there is none."""
    whole = f"cast(floor(try_cast(regexp_extract({line}, {SIZE}, 1) as double)) as double)"
    return (
        f"case regexp_extract({line}, {SIZE}, 2) when 'KiB' then {whole} / 1024.0D when 'MiB' then {whole}"
        f" when 'GiB' then {whole} * 1024.0D end"
    )


def container(fmt: str) -> str:
    """File ending a download in this format gets."""
    marks = " or ".join(f"contains({fmt}, {text(m)})" for m in ("video", "best[", "b[", "bc", "wv"))
    return f"case when {marks} or {fmt} = 'best' then '.mp4' else '.m4a' end"


def media_kind(path: str) -> str:
    return f"case when endswith({path}, '.mp4') then 'video' else 'audio' end"


def error_class(message: str) -> str:
    return f"case when contains({message}, {text(FORMAT_MISSING_TEXT)}) then 'unavailable' else 'error' end"
