"""Name and reference functions as Column expressions; no Python runs per row."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FOLDED, NAME_RANKS, PUNCTUATION, REFERENCE, SPELT_OUT, SUFFIX_PATTERNS, TYPE_WORDS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@functools.cache
def _decomposed() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """What compatibility decomposition without combining marks makes of the Latin letters: one-to-one pairs, and the rest."""
    one, to, more = "", "", []
    for code in [*range(0xC0, 0x180), *range(0x1CD, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF10, 0xFF5B)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if plain != chr(code):
            if len(plain) == 1:
                one, to = one + chr(code), to + plain
            else:
                more.append((chr(code), plain))
    return one, to, tuple(more)


def _plain(c: Column) -> Column:
    one, to, more = _decomposed()
    c = F.translate(c, one, to)
    for a, b in more:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"\p{M}+", "")


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends; null stays null."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def present(c: Column | str) -> Column:
    """The value, or null for an empty one."""
    return F.nullif(_col(c), F.lit(""))


def norm(c: Column | str) -> Column:
    """The form in which names are matched: lower-case, umlauts spelt out, accents dropped.

    Hyphens, slashes, dots, apostrophes and underscores become a space, other punctuation
    goes, and white space is collapsed. Null gives the empty string. Compatibility
    decomposition covers Latin letters.
    """
    c = low = F.lower(strip(F.coalesce(_col(c), F.lit(""))))
    for a, b in SPELT_OUT.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    # A text of ASCII letters has nothing to spell out or to decompose.
    c = F.when(low.rlike(r"[^\x00-\x7F]"), _plain(c)).otherwise(low)
    c = F.regexp_replace(c, PUNCTUATION, " ")
    c = F.regexp_replace(c, r"(?U)[^\w ]+", "")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def slug(c: Column | str) -> Column:
    """Lower-case ASCII letters and digits, all else a hyphen; accents dropped (ö to o)."""
    c = F.coalesce(_col(c), F.lit(""))
    for a, b in FOLDED.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(_plain(c), r"[^\x00-\x7F]+", "")
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def split_variants(c: Column | str) -> Column:
    """A cell split at each semicolon outside brackets; nesting never goes below zero.

    The depth is folded over the pieces between semicolons, so a bracket that spans one
    joins its pieces again.
    """
    pieces = F.split(F.coalesce(_col(c), F.lit("")), ";")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("depth"))

    def depth_after(before: Column, piece: Column) -> Column:
        marks = F.filter(F.split(F.regexp_replace(piece, "[^()]", ""), ""), lambda m: m != "")
        return F.aggregate(marks, before, lambda d, m: F.when(m == "(", d + 1).otherwise(F.greatest(d - 1, F.lit(0))))

    def step(acc: Column, piece: Column) -> Column:
        n = F.size(acc["out"])
        joined = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["out"], -1), F.lit(";"), piece)))
        out = F.when((acc["depth"] > 0) & (n > 0), joined).otherwise(F.concat(acc["out"], F.array(piece)))
        return F.struct(out.alias("out"), depth_after(acc["depth"], piece).alias("depth"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def parts(c: Column | str) -> Column:
    """Variants of a cell as array of struct(name, remark): bracketed remarks joined, empty ones and closing ``?`` dropped, nameless ones left out."""

    def part(v: Column) -> Column:
        name = strip(F.regexp_replace(strip(F.regexp_replace(v, r"\([^()]*\)", "")), r"\?+$", ""))
        remarks = F.filter(F.transform(F.regexp_extract_all(v, F.lit(r"\(([^()]*)\)"), F.lit(1)), strip), lambda r: r != "")
        return F.struct(name.alias("name"), F.array_join(remarks, "; ").alias("remark"))

    return F.filter(F.transform(split_variants(c), part), lambda p: p["name"] != "")


def variants(c: Column | str) -> Column:
    """Distinct names of a cell, in order."""
    return F.array_distinct(F.transform(parts(c), lambda p: p["name"]))


def primary(c: Column | str) -> Column:
    """The first name of a cell, or the empty string."""
    return F.coalesce(F.get(F.transform(parts(c), lambda p: p["name"]), F.lit(0)), F.lit(""))


def remark(c: Column | str) -> Column:
    return F.coalesce(F.get(F.transform(parts(c), lambda p: p["remark"]), F.lit(0)), F.lit(""))


def naive_names(c: Column | str) -> Column:
    """Names of a cell split at every semicolon, brackets and all."""
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), ";"), lambda v: strip(F.regexp_replace(v, r"\([^()]*\)", ""))), lambda v: v != "")


def name_values(c: Column | str) -> Column:
    """Variants of a name tag as array of struct(value, penalty).

    The value itself, and the parts of a `` / `` list and of a ``;`` list without penalty;
    of each of these, without a bracketed suffix, without a type word before it and
    without an `` auf X`` suffix, each with a penalty of two. Empty values are left out.
    """
    v = F.coalesce(_col(c), F.lit(""))
    none = F.array().cast("array<string>")
    plain = F.concat(F.array(v), F.when(v.contains(" / "), F.transform(F.split(v, " / "), strip)).otherwise(none), F.when(v.contains(";"), F.transform(F.split(v, ";"), strip)).otherwise(none))
    bracket, island = SUFFIX_PATTERNS
    patterns = (bracket, rf"^(?:{'|'.join(TYPE_WORDS)})\s+(.+)$", island)
    derived = F.flatten(F.transform(plain, lambda x: F.array(*[strip(F.regexp_extract(x, p, 1)) for p in patterns])))
    tagged = F.concat(F.transform(plain, lambda x: F.struct(x.alias("value"), F.lit(0).alias("penalty"))), F.transform(derived, lambda x: F.struct(x.alias("value"), F.lit(2).alias("penalty"))))
    return F.filter(tagged, lambda x: x["value"] != "")


def name_rank(key: Column | str) -> Column:
    """The trust rank of a name tag; null for other keys."""
    return F.create_map(*[F.lit(x) for kv in NAME_RANKS.items() for x in kv])[_col(key)]


def parse_refs(c: Column | str) -> Column:
    """``way/12; node/3`` as array of struct(t, id, slug); null if any part is none, or a local reference has company."""
    pieces = F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), "[;,\n]"), strip), lambda x: x != "")
    kinds = {"node": "n", "way": "w", "relation": "r", "local": "local"}
    letter = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])

    def ref(x: Column) -> Column:
        kind, rest = F.substring_index(x, "/", 1), F.regexp_replace(x, "^[a-z]+/", "")
        return F.struct(letter[kind].alias("t"), F.when(kind != "local", rest.try_cast("bigint")).alias("id"), F.when(kind == "local", rest).alias("slug"))

    good = F.forall(pieces, lambda x: x.rlike(REFERENCE))
    alone = (F.size(pieces) <= 1) | ~F.exists(pieces, lambda x: x.startswith("local/"))
    return F.when(good & alone, F.transform(pieces, ref))


def format_refs(refs: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in {"n": "node", "w": "way", "r": "relation", "local": "local"}.items() for x in kv])
    return F.array_join(F.transform(_col(refs), lambda r: F.concat(names[r["t"]], F.lit("/"), F.coalesce(r["slug"], r["id"].cast("string")))), "; ")


def ids_of(refs: Column | str, t: str) -> Column:
    return F.transform(F.filter(_col(refs), lambda r: r["t"] == t), lambda r: r["id"])


def local_of(refs: Column | str) -> Column:
    return F.get(_col(refs), F.lit(0))["slug"]


def feature_ref(feature_id: Column | str) -> Column:
    """A tile feature id (number times ten plus 1, 2 or 3) as struct(t, id); null for others."""
    n = _col(feature_id).try_cast("bigint")
    kind = F.create_map(F.lit(1), F.lit("n"), F.lit(2), F.lit("w"), F.lit(3), F.lit("r"))[(n % 10).cast("int")]
    return F.when(kind.isNotNull(), F.struct(kind.alias("t"), F.floor(n / 10).alias("id")))


def ref_of_text(c: Column | str) -> Column:
    """``way/12`` or the address of an object page as ``way/12``, in any case; else null."""
    return present(F.lower(F.regexp_extract(_col(c), r"(?i)(?:^|openstreetmap\.org/)((?:node|way|relation)/[1-9][0-9]*)(?:[/?#].*)?$", 1)))


def degrees(c: Column | str) -> Column:
    """Six decimals at most, closing zeros trimmed."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", _col(c)), r"0+$", ""), r"\.$", "")


def single_item(c: Column | str) -> Column:
    """The value only if it is exactly one item id, else the empty string."""
    return F.when(_col(c).rlike("^Q[0-9]+$"), _col(c)).otherwise(F.lit(""))


def block_of(code: Column | str) -> Column:
    """The name of a code point's block of 256: ``0-255`` and so on."""
    low = F.floor(_col(code) / 256) * 256
    return F.concat(low.cast("string"), F.lit("-"), (low + 255).cast("string"))


def blob_hash(c: Column | str) -> Column:
    """The SHA-1 of a git blob with this text."""
    data = F.encode(_col(c), "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string"), F.lit("\0")), "UTF-8"), data))


def source_name(path: Column | str) -> Column:
    """The region a file name speaks of: the base name without its endings and its date or ``latest``."""
    return F.regexp_replace(F.substring_index(F.substring_index(_col(path), "/", -1), ".", 1), r"-(latest|\d{6})$", "")


def regex_escaped(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"([.*+?^$\{}()|\[\]\\])", r"\\$1")


def tag_problem(c: Column | str) -> Column:
    """Why a language tag is not of the form language[-x-part...]; null if it is."""
    c = _col(c)
    return F.when(~c.rlike("^[a-z]{2,3}(-|$)"), F.lit("no language")).when(~c.rlike("^[a-z]{2,3}(-x(-[a-z0-9]{1,8})+)?$"), F.lit("no private-use tag"))


def cell_problem(c: Column | str) -> Column:
    """The first thing that is wrong with how a name cell is written, or null; a null cell is empty.

    Brackets neither nest nor stay open; variants are parted by a semicolon and one space; a
    variant is a name, then remarks after one space each; names have no stray spaces and no
    question mark, and none comes twice.
    """
    c = F.coalesce(_col(c), F.lit(""))
    depths = F.aggregate(F.split(F.regexp_replace(c, "[^()]", ""), ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("least"), F.lit(0).alias("most")), lambda d, m: _deeper(d, F.when(m == "(", 1).when(m == ")", -1).otherwise(0)))
    each = F.transform(split_variants(c), strip)
    name = lambda v: F.regexp_extract(v, r"^([^()]*?)(?: \([^()]*\))*$", 1)
    fits = lambda v: v.rlike(r"^[^()]*?(?: \([^()]*\))*$")
    told = F.filter(F.transform(each, lambda v: _first([
        (~fits(v), F.concat(F.lit("text after a remark in '"), v, F.lit("'"))), (name(v) == "", F.lit("an empty variant")),
        ((name(v) != strip(name(v))) | name(v).contains("  "), F.concat(F.lit("stray spaces in '"), name(v), F.lit("'"))),
        (name(v).contains("?"), F.concat(F.lit("`?` in '"), name(v), F.lit("' -- say `uncertain` in `note` instead"))),
    ])), lambda m: m.isNotNull())
    names = F.transform(parts(c), lambda p: p["name"])
    twice = F.filter(names, lambda n, i: F.array_position(names, n) <= i)
    # Most names have nothing that could be wrong, which one pattern tells.
    plain = c.rlike(r"^[\p{L}\p{M}\p{N}#'’.-]+(?: [\p{L}\p{M}\p{N}#'’.-]+)*\z")
    return _first([
        ((c == "") | plain, F.lit(None).cast("string")), ((depths["least"] < 0) | (depths["most"] > 1), F.lit("unbalanced or nested brackets")), (depths["now"] != 0, F.lit("unbalanced brackets")),
        (c.rlike(r"(?U)\s;|;(?! \S)"), F.lit("variants are separated by `; ` (no space before, one after)")), (F.size(told) > 0, F.get(told, F.lit(0))),
        (F.size(twice) > 0, F.concat(F.array_join(twice, ", "), F.lit(" twice"))),
    ])


def _deeper(d: Column, by: Column) -> Column:
    now = d["now"] + by
    return F.struct(now.alias("now"), F.least(d["least"], now).alias("least"), F.greatest(d["most"], now).alias("most"))


def _first(rules: list[tuple[Column, Column]]) -> Column:
    """The message of the first rule that is broken, null for none."""
    out = F.lit(None).cast("string")
    for test, what in reversed(rules):
        out = F.when(test, what).otherwise(out)
    return out
