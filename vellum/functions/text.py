"""Text functions over columns. All stay inside the JVM; a null text gives null unless said otherwise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What tokenising deletes besides white space, the tag words in their order, the
# tag of texts without one, the markers of a refusal, and the domains of harmless addresses.
PUNCTUATION = "。，、；：？！…—～《》「」『』（）()【】[]{}<>\"'`·,.!?;:/-_%"
TAG_WORDS = ("破损", "遗失", "拦截", "理赔", "赔偿", "罚款")
OTHER_TAG = "其他"
REFUSAL_MARKERS = ("无法回答", "没有相关", "不包含", "未提及", "无法确定", "无相关")
ALLOWED_DOMAINS = ("example.com", "example.org", "example.net", "users.noreply.github.com", "localhost")

# Fixed values too: rules of the scan for personal data and secrets; "邮箱" has the allow-list above.
PRIVACY_RULES = {
    "手机号": r"(?<!\d)1[3-9]\d{9}(?!\d)",
    "邮箱": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}",
    "身份证号": r"(?<!\d)\d{17}[\dXx](?!\d)",
    "本地绝对路径": r"/home/[A-Za-z0-9_.-]+/|/mnt/[a-z]/|[A-Za-z]:\\\\[Uu]sers\\\\",
    "密钥样式": r"sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
EMAIL_RULE = "邮箱"
#: Rules that don't fit identities, which hold an address; names of files with personal papers, and what a hit is called.
IDENTITY_EXEMPT = ("邮箱", "密钥样式")
PRIVATE_NAMES = "简历|resume|证件|身份证"
PRIVATE_NAME_RULE = "私密文件名(个人材料类)"
#: Rules of our own for shapes that those leave out.
MORE_RULES = {"card": r"(?<!\d)\d{16}(?!\d)", "token": r'token = "[0-9a-f]{16,}"'}

_SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"


#: The same characters as code points, for tasks that look at characters as numbers.
DELETED = sorted({*map(ord, PUNCTUATION), *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000})


def character_class(chars: str) -> str:
    """The inside of a regular expression's class of these characters."""
    return "".join("\\" + c if ord(c) < 128 and not c.isalnum() else c for c in chars)


def bare(text: Column) -> Column:
    """The text without punctuation and white space."""
    return F.regexp_replace(text, f"[{character_class(PUNCTUATION)}{_SPACE}]+", "")


def bigrams(text: Column) -> Column:
    """Overlapping pairs of characters, with repeats, of what is left without punctuation and white space.

    Pairs span what was deleted. One character is itself; none, or a null text, gives an empty array.
    """
    # one pass: at every character a look-ahead takes two, or the only one
    return F.regexp_extract_all(F.coalesce(bare(text), F.lit("")), F.lit("(?s)(?=(..|^.$))."), 1)


def normalize(text: Column) -> Column:
    """One kind of line end and space, no control characters or gaps between Han characters, no runs of blank lines."""
    steps = (
        (r"\r\n?", "\n"),
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
        ("[\u00a0\u3000]", " "),
        ("(?<=[\u4e00-\u9fff])[ \\t]+(?=[\u4e00-\u9fff])", ""),
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
        (r"(?Um)^[\s&&[^\n]]+|[\s&&[^\n]]+$", ""),
        (r"(?U)\A\s+|\s+\z", ""),
    )
    return reduce(lambda t, step: F.regexp_replace(t, step[0], step[1]), steps, text)


def tags(text: Column, words: tuple[str, ...] = TAG_WORDS, other: str = OTHER_TAG) -> Column:
    """Those of ``words`` that the text contains, in their order, joined by " + "; ``other`` if none."""
    found = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))
    return F.when(F.size(found) > 0, F.array_join(found, " + ")).otherwise(other)


def stem(path: Column) -> Column:
    """A file name without folders and its last suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def doc_id_of(path: Column) -> Column:
    """The stem if it is plain ASCII; "doc_" and ten hex digits of its SHA-1 if not; "document" if empty."""
    name = F.btrim(stem(path))
    name = F.when(name == "", "document").otherwise(name)
    return F.when(name.rlike(r"^[A-Za-z0-9_.\-]+$"), name).otherwise(F.concat(F.lit("doc_"), F.substring(F.sha1(name.cast("binary")), 1, 10)))


def safe_id(text: Column) -> Column:
    """With everything but letters, digits, "_", "." and "-" replaced by "_"; "doc" if empty."""
    found = F.regexp_replace(text, r"[^A-Za-z0-9_.\-]", "_")
    return F.when(found == "", "doc").otherwise(found)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a bar. Give tenant and user among them: answers may rest on either's data."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def is_refusal(answer: Column, markers: tuple[str, ...] = REFUSAL_MARKERS) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(answer, F.lit(m)) for m in markers]), F.lit(False))


def render_rows(rows: Column) -> Column:
    """A table (array of arrays of strings) as lines of "column: cell; ...", its first row that isn't blank as header.

    Blank rows are left out. A header alone is its cells joined by " | ". Empty cells are left
    out, and a cell without a header stands alone.
    """
    trimmed = F.transform(rows, lambda r: F.transform(r, lambda c: F.btrim(F.coalesce(c, F.lit("")))))
    full = F.filter(trimmed, lambda r: F.exists(r, lambda c: c != ""))

    def line(header: Column, row: Column) -> Column:
        cells = F.transform(row, lambda c, i: F.struct(F.coalesce(F.get(header, i), F.lit("")).alias("h"), c.alias("c")))
        kept = F.filter(cells, lambda x: x["c"] != "")
        return F.array_join(F.transform(kept, lambda x: F.when(x["h"] != "", F.concat(x["h"], F.lit(": "), x["c"])).otherwise(x["c"])), "; ")

    def table(t: Column) -> Column:
        header = F.try_element_at(t, F.lit(1))
        body = F.array_join(F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda row: line(header, row)), "\n")
        return F.when(F.size(t) == 0, "").when(F.size(t) == 1, F.array_join(header, " | ")).otherwise(body)

    # inside a lambda the trimmed table is a value; outside it would be worked out anew for every row
    return F.transform(F.array(full), table)[0]


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8,192."""
    return F.instr(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"), F.lit("\0")) > 0


def good_fact(text: Column, key: Column) -> Column:
    """Not just a slot's name: five characters at least, and other than the key."""
    t = F.btrim(F.coalesce(text, F.lit("")))
    return (F.char_length(t) >= 5) & ~F.coalesce((key != "") & (t == F.btrim(key)), F.lit(False))


def good_update(text: Column, key: Column) -> Column:
    """As :func:`good_fact`, and no bare "key: value"."""
    t, k = F.btrim(F.coalesce(text, F.lit(""))), F.coalesce(key, F.lit(""))
    bare_value = (k != "") & F.startswith(t, F.concat(F.btrim(k), F.lit(":"))) & (F.char_length(t) < F.char_length(k) + 6)
    return good_fact(text, key) & ~bare_value


def route_label(url: Column) -> Column:
    """A path of few forms for metrics: without host, query and fragment, and with {id} for segments that hold a digit."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    label = F.regexp_replace(path, r"[^/]*[0-9][^/]*", "{id}")
    return F.when(label == "", "/").otherwise(label)


def prompt_line(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "user", F.lit("用户: ")).otherwise(F.lit("助手: ")), text)


def literal_rule(terms: list[str]) -> str:
    """A pattern that matches any of the terms as they are."""
    return "|".join(re.escape(t) for t in terms)
