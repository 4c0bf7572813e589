"""Placeholder text from a seed: the same seed gives the same text, in five scripts and five formats.

A 32-bit generator drives it (mulberry32, seeded by FNV-1a of the seed's UTF-16 units). Its n-th number
depends on the seed and n alone, so only the count of numbers used so far is carried from sentence to
sentence: the sentences of many texts are laid out at once, a sentence of each text a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# Words, full stops, commas and joiners of each script, and the classic opening.
WORDS = {
    "classic": "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum perspiciatis unde omnis iste natus error voluptatem accusantium".split(),
    "english": "system design pattern content layout interface data model request response service client server render component state effect value change update record filter search result table column field label action button form input output version release branch commit review deploy metric report signal threshold limit account session token access policy rule check validate confirm cancel retry queue message event stream batch cache index query schema migration backup restore".split(),
    "bangla": "সময় মানুষ কাজ দেশ জীবন কথা বছর দিন হাত চোখ মন ঘর পথ নাম গান বই জল আকাশ শহর গ্রাম নদী পাখি গাছ ফুল আলো ছায়া বাতাস মাটি সকাল বিকেল রাত সপ্তাহ মাস বন্ধু পরিবার শিক্ষা স্বপ্ন আশা গল্প ইতিহাস সংস্কৃতি ভাষা লেখা পড়া শেখা".split(),
    "japanese": "時間 場所 世界 生活 仕事 会社 学校 家族 友達 言葉 文化 歴史 社会 経済 技術 情報 問題 方法 結果 理由 目的 意味 関係 変化 発展 研究 教育 環境 自然 都市 製品 顧客 市場 価格 品質 設計 開発 管理 分析 記録".split(),
    "arabic": "وقت مكان عالم حياة عمل شركة مدرسة عائلة صديق كلمة ثقافة تاريخ مجتمع اقتصاد تقنية معلومة مشكلة طريقة نتيجة سبب هدف معنى علاقة تغيير تطور بحث تعليم بيئة طبيعة مدينة منتج عميل سوق سعر جودة تصميم تطوير إدارة تحليل تسجيل".split(),
}
STOPS = {"classic": (".", ","), "english": (".", ","), "bangla": ("।", ","), "japanese": ("。", "、"), "arabic": (".", "،")}
JOINERS = {"classic": " ", "english": " ", "bangla": " ", "japanese": "", "arabic": " "}
OPENING = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."

_ALL = 0xFFFFFFFF
MOST_WORDS = 1 << 17  # that are made at a time, but for a single text of more


def _product(a: Column, b: Column | int) -> Column:
    """The low 32 bits of a product, by halves, so that nothing is too large for a long."""
    b = F.lit(b) if isinstance(b, int) else b
    high = (a * F.shiftrightunsigned(b, 16)).bitwiseAND(0xFFFF)
    return (a * b.bitwiseAND(0xFFFF) + F.shiftleft(high, 16)).bitwiseAND(_ALL)


def seed_of(text: Column) -> Column:
    """FNV-1a over the UTF-16 units of a text, as a long."""

    def unit(h: Column, u: Column) -> Column:
        return _product(h.bitwiseXOR(u), 0x01000193)

    def one(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        above = code - 0x10000
        pair = bound(unit(h, F.shiftrightunsigned(above, 10) + 0xD800), lambda x: unit(x, above.bitwiseAND(0x3FF) + 0xDC00))
        return F.when(code > 0xFFFF, pair).otherwise(unit(h, code))

    return F.aggregate(F.split(text, ""), F.lit(0x811C9DC5).cast("long"), lambda h, c: F.when(c == "", h).otherwise(one(h, c)))


def random(seed: Column, n: Column) -> Column:
    """The n-th number, from 0, of the generator: at least 0 and below 1."""
    a = (seed + _product((n + 1).cast("long"), 0x6D2B79F5)).bitwiseAND(_ALL)
    first = bound(a, lambda a: _product(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(1)))
    second = bound(first, lambda t: t.bitwiseXOR((t + _product(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(61))).bitwiseAND(_ALL)))
    return bound(second, lambda t: t.bitwiseXOR(F.shiftrightunsigned(t, 14)).cast("double") / 4294967296.0)


def _numbers(seed: np.ndarray, n: np.ndarray) -> np.ndarray:
    """random() of arrays; 32-bit products wrap by themselves."""
    a = seed + (n + 1).astype(np.uint32) * np.uint32(0x6D2B79F5)
    t = (a ^ a >> np.uint32(15)) * (a | np.uint32(1))
    t ^= t + (t ^ t >> np.uint32(7)) * (t | np.uint32(61))
    return (t ^ t >> np.uint32(14)) / 4294967296.0


def _seeds(texts: list[str]) -> np.ndarray:
    """seed_of() of texts."""
    out = np.empty(len(texts), np.uint32)
    for k, text in enumerate(texts):
        h = 0x811C9DC5
        for u in memoryview(text.encode("utf-16-le")).cast("H"):
            h = (h ^ u) * 0x01000193 & _ALL
        out[k] = h
    return out


def _pieces(flavour: str, end: str, between: str, opening: str = "") -> pa.Array:
    """Each word as it may stand in a text: within, with a comma, last of a block, last of a sentence; then the same raised (lowered after an opening)."""
    comma, joiner, latin = STOPS[flavour][1], JOINERS[flavour], flavour in ("classic", "english")
    shapes = [[w + z for w in WORDS[flavour]] for z in (joiner, comma + joiner, end, end + between)]
    shapes += [[w[:1].upper() + w[1:] if latin else w for w in shape] for shape in shapes]
    shapes += [[opening + w for w in shape] for shape in shapes[:4]]
    return pa.array([w for shape in shapes for w in shape], pa.string())


def _laid_out(seed: np.ndarray, unit: str, count: int, flavour: str) -> tuple[np.ndarray, ...]:
    """A row a sentence, in the order of the texts: its text, block, first number of its words, words, place of its comma (or -1), whether it ends its block."""
    rows, at, out = np.arange(len(seed)), np.zeros(len(seed), np.int64), []
    if unit == "words":
        full = np.full(len(seed), count)
        return rows, np.zeros_like(rows), at, full, np.full(len(seed), -1), np.ones(len(seed), bool)
    least, most = (3, 8) if unit == "list" else (6, 18)
    for block in range(count):
        said = np.ones(len(seed), np.int64)
        if unit == "paragraphs":
            said = 3 + np.floor(_numbers(seed, at) * 4).astype(np.int64)
            at = at + 1
        for k in range(said.max(initial=1)):
            r = rows[said > k]
            s, first = seed[r], at[r]
            n = least + np.floor(_numbers(s, first) * (most - least + 1)).astype(np.int64)
            after = first + 1 + n
            has = (n > 10) & (_numbers(s, after) > 0.45)
            place = np.where(has, 3 + np.floor(_numbers(s, after + 1) * (n - 6)).astype(np.int64), -1)
            at[r] = after + (n > 10) + has
            out.append((r, np.full(len(r), block), first + 1, n, place, said[r] == k + 1))
    made = [np.concatenate(x) for x in zip(*out, strict=True)]
    order = np.argsort(made[0], kind="stable")
    return tuple(x[order] for x in made)


def _texts(seeds: list[str], unit: str, count: int, flavour: str, opened: bool) -> pa.ListArray:
    """The blocks of each seed; words are taken from their shapes, and their bytes are the text."""
    full, pool = STOPS[flavour][0], len(WORDS[flavour])
    shapes = _pieces(flavour, "" if unit == "list" else full, " " if JOINERS[flavour] else "", OPENING + " ")
    seed = _seeds(seeds)
    row, block, start, n, place, last = _laid_out(seed, unit, count, flavour)
    of = np.repeat(np.arange(len(n)), n)
    here = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    word = np.floor(_numbers(seed[row[of]], start[of] + here) * pool).astype(np.int64)
    shape = np.where(here == n[of] - 1, np.where(last[of], 2, 3), (here == place[of]).astype(np.int64))
    opens = np.r_[True, last[:-1]] & (block == 0) & opened if len(last) else last
    shape += np.where(here == 0, np.where(opens[of], 8, 4), 0)
    said = shapes.take(pa.array(word + pool * shape))
    ends = np.frombuffer(said.buffers()[1], np.int32)[np.r_[0, np.cumsum(n)[last]]]
    texts = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), said.buffers()[2])
    each = 1 if unit == "words" else count
    return pa.ListArray.from_arrays(pa.array(np.arange(len(seeds) + 1) * each, pa.int32()), texts)


def blocks(seed: Column, unit: str = "paragraphs", count: int = 3, flavour: str = "classic", start_with_lorem: bool = False) -> Column:
    """The text's blocks: paragraphs (of 3 to 6 sentences), sentences, a list (of 3 to 8 words each) or words (one block).

    As many as asked for, one at least. A null seed has no blocks.
    """
    count = max(1, count)
    opened = start_with_lorem and flavour == "classic" and unit != "list"
    held = max(1, MOST_WORDS // (count * {"paragraphs": 54, "words": 1}.get(unit, 12)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for i in range(0, len(b), held):
                part = b.slice(i, held)
                there = np.array(part.is_valid())
                made = _texts(part.drop_null().to_pylist(), unit, count, flavour, opened)
                yield made.take(pa.array(np.cumsum(there) - 1, mask=~there)) if part.null_count else made

    return F.arrow_udf(run, "array<string>")(F.trim(seed))


def formatted(b: Column, unit: str = "paragraphs", form: str = "plain") -> Column:
    """Blocks as plain text, html, markdown, jsx or a script's array."""
    listed = unit == "list"
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = lambda f, by="\n": F.array_join(F.transform(b, f), by)
    around = lambda a, x, z: F.concat(F.lit(a), x, F.lit(z))
    if form == "plain":
        return F.array_join(b, "\n" if listed else "\n\n")
    if form == "markdown":
        return lines(lambda x: F.concat(F.lit("- "), x)) if listed else F.array_join(b, "\n\n")
    if form == "array":
        quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        return around("[\n", lines(lambda x: around("  ", quoted(x), ",")), "\n]")
    if listed:
        return around("<ul>\n", lines(lambda x: around("  <li>", safe(x), "</li>")), "\n</ul>")
    return lines(lambda x: around("<p>", F.regexp_replace(safe(x), "[{}]", "") if form == "jsx" else safe(x), "</p>"))
