"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_newlines(c: Column) -> Column:
    """Short strings are stored without line feeds; carriage returns stay."""
    return F.replace(c, F.lit("\n"), F.lit(""))


def thousands_float(c: Column) -> Column:
    """``1,234.5`` as a double; null where it is no number."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def epoch_timestamp(c: Column) -> Column:
    """Seconds since 1970 as text; a fraction is cut off."""
    return F.timestamp_seconds(F.floor(c.try_cast("double")).cast("long"))


def int_or_null(c: Column) -> Column:
    return c.try_cast("bigint")


def strip_suffix(c: Column, tail: str) -> Column:
    """``tail`` goes where the text ends with it."""
    return F.when(c.endswith(tail), F.substring(c, F.lit(1), F.char_length(c) - len(tail))).otherwise(c)


def strip_tags(c: Column) -> Column:
    """Markup tags go, then white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"<[^<>]*>", ""), r"^\s+|\s+$", "")


def coordinate_pairs(c: Column) -> Column:
    """All ``12.3,45.6`` pairs, joined by semicolons."""
    return F.array_join(F.regexp_extract_all(c, F.lit(r"\d+\.\d+,\d+\.\d+"), F.lit(0)), ";")


def url_host(c: Column) -> Column:
    """Host and port."""
    return F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def query_part(c: Column, prefix: str) -> Column:
    """The first part of the query that starts so, without the prefix; null without one."""
    parts = F.filter(F.split(url_query(c), "&"), lambda p: p.startswith(prefix))
    return F.substring(F.get(parts, F.lit(0)), len(prefix) + 1, 1 << 30)


def canonical_url(c: Column) -> Column:
    """Without parameters, query and fragment, which a mark replaces."""
    return F.when(c.rlike("[;?#]"), F.concat(F.regexp_replace(c, r"[;?#].*$", ""), F.lit("?*"))).otherwise(c)


def _without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments resolved."""
    last = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", last(acc)).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.array_join(F.when(path.rlike(r"(^|/)\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def join_url(base: Column, link: Column) -> Column:
    """The absolute address of a link on the page ``base``."""
    root = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    path, tail = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"[?#].*$", 0)
    folder = F.regexp_replace(F.when(url_path(base) == "", "/").otherwise(url_path(base)), r"[^/]*$", "")
    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^[^:]*:", 0), link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), link))
        .when(link.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), link))
        .otherwise(F.concat(root, _without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))), tail))
    )


def drop_parents(c: Column) -> Column:
    return F.regexp_replace(c, r"^(/\.\.|\.\./)+", "")


def after_colon(c: Column) -> Column:
    """What follows the first full-width colon; all of it without one."""
    at = F.instr(c, "：")
    return F.when(at > 0, F.substring(c, at + 1, F.char_length(c))).otherwise(c)


def first_number(c: Column) -> Column:
    """The first number, numeric character references aside; null without one."""
    return F.regexp_extract(F.regexp_replace(c, r"&#\d+;", ""), r"\d+(\.\d+)?", 0).try_cast("double")


def number_or_zero(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"\d+(\.\d+)?", 0).try_cast("double"), F.lit(0.0))


def trim_title_prefix(c: Column, prefix: str) -> Column:
    """A trivial prefix goes, with what stands before it, if it begins at the second to fifth character."""
    at = F.instr(c, prefix)
    return F.when(at.between(2, 5), F.substring(c, at + len(prefix), F.char_length(c))).otherwise(c)


def is_blank(c: Column) -> Column:
    return c.rlike(r"^\s*$")


def contains_after_start(c: Column, needle: str) -> Column:
    """Found anywhere but at the very start."""
    return F.instr(c, needle) > 1


def app_address(c: Column, suffix: str) -> Column:
    """A bare name gets the hosting suffix; other addresses with a dot are none."""
    return F.when(~c.contains("."), F.concat(c, F.lit(suffix))).when(c.endswith(suffix), c)


def shorten_link_text(c: Column) -> Column:
    """Parts of more than five characters are cut to four; each part gets a slash before it."""
    return F.concat(F.lit("/"), F.array_join(F.transform(F.split(c, "/"), lambda p: F.when(F.char_length(p) > 5, F.substring(p, 1, 4)).otherwise(p)), "/"))


def decode_list(c: Column, separator: str = ";") -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, f"\\Q{separator}\\E"))


def encode_list(c: Column, separator: str = ";") -> Column:
    return F.array_join(c, separator)


def keyed_md5(payload: Column, secret: str) -> Column:
    return F.md5(F.concat(F.lit(secret), payload))


def matching_label(c: Column, labels: dict[str, str]) -> Column:
    """The first label whose pattern is found."""
    result = None
    for label, pattern in labels.items():
        result = F.when(c.rlike(pattern), label) if result is None else result.when(c.rlike(pattern), label)
    return result
