"""String and formatting functions as Columns; Python only where bytes must be counted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ESCAPES = (("%", "%25"), ("|", "%7C"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"))


def percent_encode(x: Column) -> Column:
    """Encode percent, pipe, tab and line ends, the percent first."""
    for plain, code in _ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def percent_decode(x: Column) -> Column:
    """Undo ``percent_encode``, the percent last."""
    for plain, code in reversed(_ESCAPES):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def display_unescape(x: Column) -> Column:
    """Decode for display: encoded tabs stay as they are, real tabs become spaces."""
    for plain, code in (*[e for e in reversed(_ESCAPES) if e[0] not in "\t%"], _ESCAPES[0]):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return F.replace(x, F.lit("\t"), F.lit(" "))


def byte_escape(x: Column) -> Column:
    """Bytes as printable ASCII: others, percent, pipe and backslash as %HH."""
    each = F.filter(F.split(F.regexp_replace(F.hex(x), "(..)", "$1 "), " "), lambda h: h != "")
    plain = lambda h: h.between("20", "7E") & ~h.isin("25", "7C", "5C")
    return F.when(x.isNotNull(), F.array_join(F.transform(each, lambda h: F.when(plain(h), F.unhex(h).cast("string")).otherwise(F.concat(F.lit("%"), h))), ""))


def json_quote(x: Column) -> Column:
    return F.substring(F.to_json(F.struct(x.alias("v"))), F.lit(6), F.char_length(F.to_json(F.struct(x.alias("v")))) - 6)


def strip_slash(path: Column) -> Column:
    """A path without trailing slashes; the root stays."""
    return F.regexp_replace(path, r"(?<=.)/+$", "")


def fit_name(x: Column, width: int) -> Column:
    """A name cut to ``width`` bytes with an ellipsis of one sign, at a character's edge; a name that fits is unchanged."""

    @F.pandas_udf(StringType())
    def cut(names: pd.Series) -> pd.Series:
        def one(name: str | None) -> str | None:
            if name is None or len(name.encode()) <= width:
                return name
            return name.encode()[: width - 1].decode(errors="ignore") + "…"

        return names.map(one)

    return cut(x)


def fnv1a64(x: Column) -> Column:
    """FNV-1a, 64 bits, as 16 hexadecimal digits."""

    @F.pandas_udf(StringType())
    def digest(data: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            h = 0xCBF29CE484222325
            for c in bytes(b):
                h = (h ^ c) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            return f"{h:016x}"

        return data.map(one)

    return digest(x)


def tokens(x: Column, pattern: str = r"[^0-9A-Za-z]+") -> Column:
    return F.filter(F.split(x, pattern), lambda t: t != "")


def atlas_hint(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "[^a-z0-9]+"), F.array(*[F.lit(x) for x in ("atlas", "atlases", "spritesheet", "spritesheets")]))


def fuzzy_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^0-9a-z]", "")


def safe_path(path: Column) -> Column:
    """A relative path without empty, dot or parent parts, backslashes or colons."""
    parts = F.split(path, "/")
    return ~F.exists(parts, lambda p: p.isin("", ".", "..")) & ~path.rlike(r"[\\:]")


def normalised_list(x: Column) -> Column:
    """A comma list in lower case, trimmed, in order, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(x), ","), lambda t: F.trim(t)), lambda t: t != ""))


def compression_level(options: Column) -> Column:
    """The zstd level of mount options: the last ``compress-force`` before the last ``compress``; 3 without a level; null if it is none."""
    parts = F.split(options, ",")

    def last(key: str) -> Column:
        return F.try_element_at(F.filter(parts, lambda p: F.startswith(p, F.lit(key))), F.lit(-1))

    kind = F.coalesce(F.substring_index(last("compress-force="), "=", -1), F.substring_index(last("compress="), "=", -1))
    return F.when(kind == "zstd", 3).when(kind.rlike(r"^zstd:[0-9]+$"), F.substring_index(kind, ":", -1).cast("int"))


def mount_class(options: Column) -> Column:
    return F.when(compression_level(options).isNotNull(), "zstd").when(options.rlike(r"(^|,)compress(-force)?="), "compressed").otherwise("uncompressed")


def bytes_human(n: Column, units: str = "KMGTPE") -> Column:
    """Bytes as text: whole below 1024, else one decimal with K to E (the last of ``units`` takes all beyond it), halves to even; a sign in front."""
    size = F.abs(n).cast("double")
    text = F.concat(F.abs(n).cast("string"), F.lit("B"))
    for i, unit in enumerate(units, 1):
        text = F.when(size >= float(1024**i), F.concat(F.format_string("%.1f", F.bround(size / float(1024**i), 1)), F.lit(unit))).otherwise(text)
    return F.concat(F.when(n < 0, "-").otherwise(""), text)


def bytes_label_truncated(n: Column) -> Column:
    """Bytes as text with the decimal cut off, in whole numbers only."""
    tenth = lambda d: F.floor(n * 10 / d).cast("long")
    one = lambda d, unit: F.concat(F.floor(tenth(d) / 10).cast("string"), F.lit("."), (tenth(d) % 10).cast("string"), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1048576, one(1024, "K")).otherwise(one(1048576, "M"))


def mib_human(n: Column) -> Column:
    return F.when(n >= 1048576, F.format_string("%.2f TiB", F.bround(n / 1048576.0, 2))).when(n >= 1024, F.format_string("%.2f GiB", F.bround(n / 1024.0, 2))).otherwise(F.format_string("%d MiB", n.cast("long")))


def to_mib(x: Column) -> Column:
    """MiB of a size with a unit (or bytes), truncated; null if it is none."""
    number = F.regexp_extract(x, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGTP]?)(?:i?B)?\s*$", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(x, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGTP]?)(?:i?B)?\s*$", 2))
    scale = F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).when(unit == "T", 1024.0**4).when(unit == "P", 1024.0**5).otherwise(1.0)
    return (number * scale / 1048576).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part * 100, whole), F.lit(0.0))


def progress_bar(done: Column, total: Column, width: int) -> Column:
    filled = F.least(F.lit(width), F.greatest(F.lit(0), F.floor(F.coalesce(F.try_divide(done * width, total), F.lit(0))))).cast("int")
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(width) - filled))


def resolution_rank(name: Column) -> Column:
    """Lines of a name such as 720p, or of 4k."""
    lines = F.regexp_extract(F.lower(name), r"^([0-9]+)p$", 1)
    return F.when(lines != "", lines.try_cast("int")).when(F.lower(name) == "4k", 2160)


def minute(epoch: Column, offset_s: int = 0) -> Column:
    """Epoch seconds as YYYY-MM-DD HH:MM at an offset from UTC; the session's zone must be UTC."""
    return F.date_format(F.timestamp_seconds(epoch + offset_s), "yyyy-MM-dd HH:mm")


def offset_seconds(x: Column) -> Column:
    """Seconds of +HHMM."""
    total = F.substring(x, 2, 2).cast("int") * 3600 + F.substring(x, 4, 2).cast("int") * 60
    return F.when(F.startswith(x, F.lit("-")), -total).otherwise(total)


# The codes of languages and the names that stand for each.
LANGUAGES = {
    "en": "en eng english", "fr": "fr fra fre french", "de": "de deu ger german", "es": "es spa spanish", "it": "it ita italian", "pt": "pt por portuguese", "ru": "ru rus russian",
    "pl": "pl pol polish", "ja": "ja jpn japanese", "ko": "ko kor korean", "zh": "zh chi zho chinese chinesesimplified chinesetraditional", "tr": "tr tur turkish", "nl": "nl dut nld dutch",
    "sv": "sv swe swedish", "fi": "fi fin finnish", "da": "da dan danish", "no": "no nor norwegian", "cs": "cs cze ces czech", "hu": "hu hun hungarian", "el": "el gre ell greek",
    "ar": "ar ara arabic", "he": "he heb hebrew", "th": "th tha thai", "vi": "vi vie vietnamese", "uk": "uk ukr ukrainian", "id": "id ind indonesian", "ro": "ro ron rum romanian",
    "bg": "bg bul bulgarian", "hr": "hr hrv croatian", "sk": "sk slk slo slovak",
}


def _language(word: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for code, names in LANGUAGES.items() for n in names.split() for x in (n, code)]), word)


def language_of(name: Column) -> Column:
    """The code of a name's first word if that is a language's, such as fr_FR, English(US) or es-419; null for any other name."""
    return _language(F.try_element_at(F.filter(F.split(F.lower(name), r"[()_\-. ]+"), lambda t: t != ""), F.lit(1)))


def language_in(stem: Column) -> Column:
    """The code of the first word of a file's stem that is a language's, where there are other words; null otherwise."""
    words = F.filter(F.split(F.lower(stem), r"[_\-. ]+"), lambda t: t != "")
    found = F.filter(F.transform(words, _language), lambda c: c.isNotNull())
    return F.when(F.size(words) > 1, F.try_element_at(found, F.lit(1)))


def language_base(stem: Column) -> Column:
    """The words of a file's stem but for the first one that is a language's."""
    words = F.filter(F.split(stem, r"[_\-. ]+"), lambda t: t != "")
    at = F.array_position(F.transform(words, lambda t: _language(F.lower(t)).isNotNull()), True)
    return F.array_join(F.filter(words, lambda _, i: i + 1 != at), "_")


def platform(id_: Column, like: Column, variant: Column) -> Column:
    """A platform's name: by exact id, else the first family in ID_LIKE, with the variant above both."""
    family = F.when(like.contains("ubuntu"), "Ubuntu").when(like.contains("debian"), "Debian").when(like.contains("fedora"), "Fedora").when(like.contains("arch"), "Arch")
    own = F.when(id_ == "steamos", "SteamOS").when(id_ == "bazzite", "Bazzite").when(id_ == "ubuntu", "Ubuntu").when(id_ == "debian", "Debian").when(id_ == "fedora", "Fedora").when(id_ == "arch", "Arch")
    return F.coalesce(F.when(variant.contains("steamdeck"), "SteamOS"), own, family, F.lit("Linux"))
