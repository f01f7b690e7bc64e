"""Text functions as columns: built-in expressions only. Whitespace is Unicode's plus U+001C to U+001F; a word
character is a letter, a number or the underscore."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1C-\x1F]+"
TOKEN = r"(?U)[^\s\x1C-\x1F]+"
#: Word characters and the Arabic block. Fixed values.
KEPT = r"\p{L}\p{N}_\x{0600}-\x{06FF}"
#: Arabic letters that are folded, and marks that are dropped. Fixed values.
FOLD_FROM, FOLD_TO = "أآإؤئ", "اااوى"
TATWEEL, DIACRITICS = "ـ", "".join(chr(c) for c in range(0x064B, 0x0653))
#: Article-bearing prefixes. Fixed values.
PREFIXES = ("وبال", "فبال", "وكال", "فكال", "وال", "فال", "بال", "كال", "ولل", "فلل", "لل", "ال")
#: Literal placeholders: printf, double and single braces. A fixed pattern.
PLACEHOLDER = r"%\p{Nd}+\$[sd@]|%[sd@]|\{\{[\p{L}\p{N}_]+\}\}|\{\p{Nd}+\}|\{[\p{L}\p{N}_]+\}"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip_token(c: Column) -> Column:
    """A token without leading and trailing characters that are no word characters (Arabic ones stay)."""
    return F.regexp_replace(c, f"^[^{KEPT}]+|[^{KEPT}]+$", "")


def strip_span(c: Column) -> Column:
    return F.array_join(F.filter(F.transform(tokens(c), strip_token), lambda t: t != ""), " ")


def normalize_ar(c: Column, fold_taa: bool = True, strip_diacritics: bool = True) -> Column:
    """Tatweel (and diacritics) dropped, alef, waw and yeh carriers folded, taa marbuta to haa, spaces collapsed."""
    src, dst = FOLD_FROM + ("ة" if fold_taa else ""), FOLD_TO + ("ه" if fold_taa else "")
    return collapse(F.translate(c, src + TATWEEL + (DIACRITICS if strip_diacritics else ""), dst))


def light_stem_ar(c: Column) -> Column:
    """One article-bearing prefix off each word, where two characters stay."""
    return F.regexp_replace(c, f"(^| )(?:{'|'.join(PREFIXES)})(?=[^ ]{{2}})", "$1")


def normalize_span(c: Column, fold_taa: bool = True, strip_clitics: bool = True, strip_diacritics: bool = True) -> Column:
    out = normalize_ar(c, fold_taa, strip_diacritics)
    return light_stem_ar(out) if strip_clitics else out


def normalize_key(c: Column) -> Column:
    return collapse(F.lower(c))


def norm_edit_distance(a: Column, b: Column) -> Column:
    return F.coalesce(F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)), F.lit(0.0))


def entropy(counts: Column) -> Column:
    """Shannon entropy of an array of counts over its maximum; 0 for fewer than two or no total."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    # the total is bound once: an expression of the outer row would be worked out again for each count
    h = F.get(F.transform(F.array(total), lambda t: F.aggregate(counts, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / t * F.log2(c / t)).otherwise(0.0))), F.lit(0))
    return F.when((F.size(counts) < 2) | (total == 0), F.lit(0.0)).otherwise(h / F.log2(F.size(counts).cast("double")))


def is_contained(short: Column, long: Column) -> Column:
    """Whether a span's words are a run of another's, strictly shorter."""
    return (short != "") & (short != long) & F.contains(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" ")))


def splice(target: Column, lo: Column, hi: Column, corrected: Column) -> Column:
    """Words lo to hi of the target replaced; the whole target where the range is no range of it."""
    t = tokens(target)
    ok = lo.isNotNull() & hi.isNotNull() & (lo >= 0) & (hi >= lo) & (hi < F.size(t))
    return F.when(ok, F.array_join(F.concat(F.slice(t, F.lit(1), F.greatest(lo, F.lit(0))), F.array(corrected), F.slice(t, F.coalesce(hi, F.lit(0)) + 2, F.size(t))), " ")).otherwise(corrected)


def literal_placeholders(c: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(c, F.lit(PLACEHOLDER), F.lit(0)))


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def char_class(ch: Column) -> Column:
    """Why a character deserves a look; empty if it doesn't."""
    cp = F.conv(F.hex(F.encode(ch, "utf-32")), 16, 10).cast("long")
    named = [
        (cp < 0x20, "control"),
        (cp == 0xA0, "no-break space"),
        (cp == 0x640, "tatweel"),
        (cp.between(0x200B, 0x200F), "zero-width / mark"),
        (cp.between(0x202A, 0x202E) | cp.between(0x2066, 0x2069), "bidi control"),
        (cp.between(0x41, 0x5A) | cp.between(0x61, 0x7A), "Latin letter"),
        (cp.between(0x30, 0x39), "ASCII digit"),
        (cp == 0x6CC, "Farsi yeh (ی)"),
        (cp == 0x6A9, "Farsi keheh (ک)"),
        (cp == 0x649, "alef maksura"),
    ]
    out = F.lit("")
    for cond, name in reversed(named):
        out = F.when(cond, name).otherwise(out)
    return out


def unusual_chars(c: Column) -> Column:
    """The characters of a text that deserve a look, as structs of character, code point and class."""
    each = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(x.alias("ch"), F.concat(F.lit("U+"), F.regexp_replace(F.hex(F.encode(x, "utf-32")), "^0{1,4}", "")).alias("cp"), char_class(x).alias("cls")))
    return F.array_distinct(F.filter(each, lambda x: x["cls"] != ""))


def char_diff(a: Column, b: Column) -> Column:
    """Edit script of the longest common subsequence: =x kept, -x deleted, +x added; on a tie deletion comes first."""

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return _diff(x, y)

    return run(a, b)


def _diff(a, b):
    def script(x: str, y: str) -> str:
        n, m = len(x), len(y)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in reversed(range(n)):
            for j in reversed(range(m)):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        out, i, j = [], 0, 0
        while i < n or j < m:
            if i < n and j < m and x[i] == y[j]:
                out.append("=" + x[i])
                i, j = i + 1, j + 1
            elif i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
                out.append("-" + x[i])
                i += 1
            else:
                out.append("+" + y[j])
                j += 1
        return "".join(out)

    return pd.Series([script(x or "", y or "") for x, y in zip(a, b)])
