"""Spoken words of a subtitle file: what is left once cues, markup, noises and adverts are gone.

Small text helpers used inside Arrow batches by the leak search and the reading-level operator.
A null or blank text has no spoken words.  Whole texts are processed, never prefixes.
"""

from __future__ import annotations

import html
import re
import unicodedata

# Wording of credits and adverts in subtitle files, folded, by language.
ADVERT_PHRASES = (
    ".example",
    "www.",
    "subtitles by",
    "corrected by",
    "downloaded from",
    "rate this subtitle",
    "become a vip member",
    "without adverts",
    "subtitulos de",
    "corregido por",
    "descargado de",
    "vota este subtitulo",
    "hazte vip",
    "sin anuncios en",
    "untertitel von",
    "korrigiert von",
    "heruntergeladen von",
    "bewerte diese untertitel",
    "werde mitglied bei",
    "folgen ohne werbung",
    "**",
    ">>",
    "===",
    "~~~",
)

# Digits that character recognition puts in place of letters.
DIGIT_LETTERS = str.maketrans("015", "ols")

_INVISIBLE = re.compile("[\\u0080-\\u009f\\u00ad\\u200b-\\u200d\\u2060\\ufeff]")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_TAG = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
_NOISE = re.compile(r"\[[^\[\]]{0,80}\]|\([^()]{0,80}\)")
_SPEAKER = re.compile(r"^\s*-?\s*[A-ZÀ-Þ][A-ZÀ-Þ.' ]+:\s")
_FOREIGN = re.compile("[Ͱ-ӿ　-鿿＀-￯\U0001f000-\U0001faff]")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[a-z0-9]+")
# Scripts written without blanks (kana, Han, Thai, Lao, Khmer, Burmese): each character is a word of its own.
_DENSE = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\u0e00-\\u0eff\\u1000-\\u109f\\u1780-\\u17ff"
_ANY_WORD = re.compile(f"[{_DENSE}]|[^\\W_{_DENSE}]+")


def _misread_table() -> dict[str, str]:
    """Wrong decodings of accented letters and quotes, from the codecs that produce them."""
    table: dict[str, str] = {}
    for char in [*map(chr, range(0xC0, 0x100)), *"‘’“”–—…♪", *map(chr, range(0xA1, 0xC0))]:
        once = [char.encode("utf-8").decode(codec, "ignore") for codec in ("cp1252", "latin-1", "mac_roman")]
        twice = [x.encode("utf-8").decode("cp1252", "ignore") for x in once[:2]] + [once[1].encode("utf-8").decode("latin-1")]
        for wrong in [*once, *twice]:
            for seen in (wrong, _INVISIBLE.sub("", wrong)):
                if len(seen) > 1 and not seen.isascii():
                    table.setdefault(seen, char)
    return table


def _fold_table() -> dict[str, str]:
    """Lower-case plain letters for the Latin letters with accents and the full-width forms."""
    table = {}
    for code in [*range(0xA0, 0x250), *range(0xFF01, 0xFF5F), *range(0xFB00, 0xFB07)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code).casefold()) if not unicodedata.combining(c))
        table[chr(code)] = plain
    return table | dict.fromkeys(map(chr, range(0x300, 0x370)), "")


_MISREAD_TABLE = _misread_table()
_MISREAD = re.compile("|".join(map(re.escape, sorted(_MISREAD_TABLE, key=len, reverse=True))))
_MISREAD_HINT = re.compile("[ÃÂâ√¬]")
_FOLD_TABLE = _fold_table()


def repair_encoding(text: str) -> str:
    """Undo UTF-8 read as a one-byte encoding, once or twice; other text is unchanged."""
    return _MISREAD.sub(lambda m: _MISREAD_TABLE[m.group()], text) if _MISREAD_HINT.search(text) else text


def fold(text: str) -> str:
    """Lower case without accents, ligatures or full-width forms."""
    if text.isascii():
        return text.lower()
    return _NOT_ASCII.sub(lambda m: _FOLD_TABLE.get(m.group(), m.group()), text).lower()


def _without_lines(text: str, phrase: str) -> str:
    """The text without the lines that hold the phrase."""
    at = text.find(phrase)
    while at >= 0:
        start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        text = text[:start] + text[end:] if end >= 0 else text[:start]
        at = text.find(phrase, start)
    return text


def _spoken_lines(text: str) -> list[str]:
    kept: list[str] = []
    for line in text.split("\n"):
        if "-->" in line:
            if kept and kept[-1].strip().isdigit():
                kept.pop()
        elif line and not line.isspace():
            kept.append(line)
    return kept


def _aside(text: str) -> tuple[str, str]:
    """(lines of the script that most of the text is in, lines of another script) of a mostly Latin text; else all stays."""
    if text.isascii():
        return text, ""
    foreign = len(_FOREIGN.findall(text))
    if not foreign or 2 * foreign >= len(_LETTER.findall(text)):
        return text, ""
    lines = text.split("\n")
    apart = [len(_FOREIGN.findall(x)) >= 3 for x in lines]
    return "\n".join(x for x, a in zip(lines, apart, strict=True) if not a), "\n".join(x for x, a in zip(lines, apart, strict=True) if a)


def spoken_text(text: str | None) -> str:
    """Spoken lines in reading order, folded; line breaks kept."""
    return spoken_parts(text)[0]


def spoken_parts(text: str | None) -> tuple[str, str]:
    """(spoken lines in reading order, folded; lines of another script that stand among them, folded).

    A text that is mostly not in Latin letters is kept whole in the first part.
    """
    if not text:
        return "", ""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = repair_encoding(_INVISIBLE.sub("", repair_encoding(text)))
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = _spoken_lines(text)
    text = "\n".join(_SPEAKER.sub("", x) if ":" in x else x for x in lines)
    if "<" in text or "{" in text:
        text = _TAG.sub("", text)
    if "[" in text or "(" in text:
        text = _NOISE.sub(" ", text)
    if "♪" in text or "*" in text or text.startswith("WEBVTT"):
        text = "\n".join(
            x for x in text.split("\n") if "♪" not in x and x != "WEBVTT" and not ((y := x.strip())[:1] == "*" and y[-1:] == "*")
        )
    text, aside = _aside(text)
    text = fold(text)
    for phrase in ADVERT_PHRASES:
        if phrase in text:
            text = _without_lines(text, phrase)
    return text, fold(aside)


def words(folded: str) -> list[str]:
    """Words of folded text in any script; a digit inside a word of letters counts as the letter it resembles."""
    found = _WORD.findall(folded) if folded.isascii() else _ANY_WORD.findall(folded)
    return [w if w.isalpha() or w.isdigit() else w.translate(DIGIT_LETTERS) for w in found]
