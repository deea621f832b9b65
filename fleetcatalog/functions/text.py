"""Names, versions, lists and ``key=value`` texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import TARGET_VERSIONS

# "=" splits the text into exactly two parts; empty parts at the end do not count.
PAIR = r"^[^=]*=[^=]+=*\z"


def name_hex(name: Column) -> Column:
    """Lower-case hex of the UTF-8 bytes. This is an encoding, not a digest."""
    return F.lower(F.hex(F.encode(name, "UTF-8")))


def env_name(name: Column) -> Column:
    """Environment-variable spelling: every non-word character becomes ``_``."""
    return F.upper(F.regexp_replace(name, r"\W", "_"))


def compat_version(version: Column) -> Column:
    """Text before the first dot."""
    return F.substring_index(version, ".", 1)


def version_rank(version: Column) -> Column:
    """Place of a target version in their declared order; null for an unknown one."""
    rank = F.lit(None).cast("int")
    for place, known in enumerate(TARGET_VERSIONS):
        rank = F.when(version == known, F.lit(place)).otherwise(rank)
    return rank


def major_minor_tag(version: Column) -> Column:
    """First two characters of the version without its dots (``2.10.1`` gives ``21``)."""
    return F.left(F.replace(version, F.lit("."), F.lit("")), F.lit(2))


def package_name(name: Column, tags: Column, compat: Column) -> Column:
    """``name-<first tag>``, or ``name-v<compat>`` when there is no tag."""
    first = F.try_element_at(tags, F.lit(1))
    return F.concat(name, F.lit("-"), F.coalesce(first, F.concat(F.lit("v"), compat)))


def artifact_name(name: Column, digest: Column) -> Column:
    """File name with the digest put before its last extension.

    A name without a dot gets the digest at its end; archives always have one.
    """
    dotted = r"^(?s)(.*)(\.[^.]*)\z"
    stem = F.regexp_extract(name, dotted, 1)
    ext = F.regexp_extract(name, dotted, 2)
    return F.when(F.instr(name, ".") > 0, F.concat(stem, F.lit("-"), digest, ext)).otherwise(
        F.concat(name, F.lit("-"), digest)
    )


def name_or_path(name: Column, path: Column) -> Column:
    """The given name, else the path text."""
    return F.coalesce(name, path)


def list_text(items: Column) -> Column:
    """``["a", "b"]``."""
    quoted = F.transform(items, lambda item: F.concat(F.lit('"'), item.cast("string"), F.lit('"')))
    return F.concat(F.lit("["), F.concat_ws(", ", quoted), F.lit("]"))


def config_present(text: Column, folder_exists: Column) -> Column:
    """Generated text is not empty, or the source folder exists."""
    return (F.coalesce(F.length(text), F.lit(0)) > 0) | F.coalesce(folder_exists, F.lit(False))


def is_pair(text: Column) -> Column:
    """Whether ``text`` reads as ``key=value``: ``a=`` and ``a=b=c`` do not, ``=b`` and ``a=b=`` do."""
    return text.rlike(PAIR)


def pair_key(text: Column) -> Column:
    return F.when(is_pair(text), F.substring_index(text, "=", 1))


def pair_value(text: Column) -> Column:
    return F.when(is_pair(text), F.regexp_extract(text, r"^[^=]*=([^=]+)", 1))


def flag_args(flag: str, values: Column) -> Column:
    """Command-line words for ``values``: ``flag value``, or ``flag=value`` for a value led by a dash."""
    words = F.transform(
        values,
        lambda v: F.when(
            v.cast("string").startswith("-"), F.array(F.concat(F.lit(flag + "="), v.cast("string")))
        ).otherwise(F.array(F.lit(flag), v.cast("string"))),
    )
    return F.flatten(words)
