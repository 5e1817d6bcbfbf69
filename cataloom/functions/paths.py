"""Path and name functions as Column expressions (JVM side, codegen friendly).

Catalog paths follow one separator style per catalog: ``windows`` (both ``\\``
and ``/`` separate, ``\\`` is written) or ``posix`` (only ``/``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex fragments for the separators of each style.
_SEP_CLASS = {"windows": r"[\\/]", "posix": r"/"}
_NOT_SEP = {"windows": r"[^\\/]", "posix": r"[^/]"}
_WRITE_SEP = {"windows": "\\", "posix": "/"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path, style: str = "windows") -> Column:
    """Last path segment; trailing separators are ignored."""
    return F.regexp_extract(_col(path), f"({_NOT_SEP[style]}*){_SEP_CLASS[style]}*$", 1)


def dirname(path, style: str = "windows") -> Column:
    """Parent folder. A file right under a drive or the root keeps the
    root's separator (``D:\\x`` gives ``D:\\``); a bare name gives ``.``."""
    p = _col(path)
    sep, not_sep = _SEP_CLASS[style], _NOT_SEP[style]
    trimmed = F.regexp_replace(p, f"{sep}+$", "")
    parent = F.regexp_replace(trimmed, f"{sep}+{not_sep}*$", "")
    root = F.lit(_WRITE_SEP[style])
    return (F.when(~trimmed.rlike(sep), F.when(p.rlike(f"^{sep}"), F.substring(p, 1, 1)).otherwise(F.lit(".")))
             .when(parent.rlike("^[A-Za-z]:$"), F.concat(parent, root))
             .when(parent == "", F.substring(p, 1, 1))
             .otherwise(parent))


def path_join(*parts, style: str = "windows") -> Column:
    """Join segments with the style's separator: repeated separators count
    once, ``.`` is dropped, ``..`` drops the segment before it (at the root,
    nothing; before the first name of a relative path it stays)."""
    whole = F.concat_ws(_WRITE_SEP[style], *[_col(p) for p in parts])
    rooted = whole.rlike(f"^{_SEP_CLASS[style]}")
    names = F.filter(F.split(whole, _SEP_CLASS[style]), lambda x: ~x.isin("", "."))
    up = lambda done: (F.size(done) > 0) & (F.element_at(done, -1) != "..")

    def step(done, name):
        return (F.when(name != "..", F.array_append(done, name))
                 .when(up(done), F.slice(done, F.lit(1), F.size(done) - 1))
                 .when(rooted, done)
                 .otherwise(F.array_append(done, name)))

    kept = F.aggregate(names, F.array().cast("array<string>"), step)
    sep = F.lit(_WRITE_SEP[style])
    return F.concat(F.when(rooted, sep).otherwise(F.lit("")), F.array_join(kept, _WRITE_SEP[style]))


def replace_first(path, old: str, new: str) -> Column:
    """Replace the first occurrence of ``old`` anywhere in the string, case
    sensitive, no separator check; unchanged when ``old`` does not occur."""
    p = _col(path)
    at = F.instr(p, old)
    return F.when(at > 0, F.overlay(p, F.lit(new), at, F.lit(len(old)))).otherwise(p)


def image_file_name(file_list_id, sort) -> Column:
    """The sort number has three digits at least and is never cut."""
    return F.format_string("img%d_%03d.png", _col(file_list_id), _col(sort))


def image_path(file_list_id, sort) -> Column:
    return F.concat(F.lit("/images/"), image_file_name(file_list_id, sort))


def static_url(image, base_url: str | None = None) -> Column:
    """URL of a stored image; the stored value starts with ``/``, so the
    URL carries a doubled slash, as the reference's own output does."""
    url = F.concat(F.lit("/static/"), _col(image))
    return url if base_url is None else F.concat(F.lit(base_url), url)
