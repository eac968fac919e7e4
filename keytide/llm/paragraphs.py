"""Numbered paragraphs and headnotes of decisions, as sentences of words that can speak of a subject."""

from __future__ import annotations

import re

#: Characters of scanned and copied texts that stand for others, or for none.
_CHARS = {"\r\n": "\n", "\r": "\n", "\x0c": "\n", "\xad": "", "\u200b": "", "\ufeff": "", "\xa0": " ", "\u202f": " ", "\u2009": " ", "\u2007": " ", "\u2018": "'", "\u2019": "'", "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl"}
_BROKEN_WORD = re.compile(r"(?<=[^\W\d_])[-\u2010] ?\n+ *(?=[^\W\d_])")
#: Headings before headnotes and reasons (fixed values).
_HEADINGS = {"HEADNOTE", "HEADNOTES", "SOMMAIRE", "LEITSATZ", "LEITSÄTZE", "REASONS", "MOTIFS", "GRÜNDE"}
#: How a numbered paragraph or headnote starts.
_MARK = re.compile(r"(?:(?:Rn\.?|§|¶|Para\.?) ?\d{1,3}\b|\[\d{1,3}\]|\(?\d{1,3}\)|\d{1,3}\.(?= )|\d{1,3}(?= [^\W\d_a-z]))")
#: Lines of page headers and footers within paragraphs: page counts, running court names, running case numbers.
_PAGE_LINE = re.compile(r"[—–-]+ *\w+ \d+ \w+ \d+ *[—–-]+|\d+ ?[A-ZÀ-Ü' ]{8,}|\[\d{4}\] [A-Z]{2,4} \d+ [–—-] \d+|[^\n]+?(?: v\. | c/ | \./\. )[^\n]+?  +\d+|\d+")
_SENTENCE = re.compile(r"(?<=[.;!?:])\s+(?=[^\W\d_a-zß-ÿ]|\[)")
_WORD = re.compile(r"[a-zß-öø-ÿœ]{4,}")
#: The same where words written large, other than the first, are left out.
_SMALL_WORD = re.compile(r"(?:^[^\W\d_]|(?<![^\W\d_])[a-zß-öø-ÿœ])[a-zß-öø-ÿœ]{3,}")
#: Words by which the languages are told apart (fixed values).
_TELLING = {"en": (" the ", " of ", " and "), "de": (" der ", " die ", " das ", " und "), "fr": (" la ", " le ", " les ", " et ")}


def units_of(text: str | None) -> list[str]:
    """The numbered paragraphs and headnotes of a text, without caption, page lines and broken words.

    A null, empty or blank text has none. A text without numbers or headings is one unit.
    """
    if not text or text.isspace():
        return []
    for char, by in _CHARS.items():
        text = text.replace(char, by)
    if "-\n" in text or "- \n" in text or "\u2010" in text:
        text = _BROKEN_WORD.sub("", text)
    units, before, body = [], [], False
    for line in text.split("\n"):
        line = line.strip()
        if not line or (len(line) < 190 and (line[0] in "0123456789[—–-" or line[-1].isdigit()) and _PAGE_LINE.fullmatch(line)):
            continue
        heading = len(line) < 12 and line.rstrip(" :").upper() in _HEADINGS
        mark = None if heading else _MARK.match(line)
        if heading or mark:
            body = True
            units.append([] if heading else [line[mark.end() :]])
        elif body:
            units[-1].append(line)
        else:
            before.append(line)
    return [u for u in (" ".join(" ".join(parts).split()) for parts in (units if body else [before])) if u]


def sentences_of(unit: str, lang: str) -> list[list[str]]:
    """The sentences of a paragraph, each as its words of four letters and more in lower case.

    In English and French, words written large within a sentence are names of persons, firms and courts, and are left out
    (a sentence that is written large throughout keeps its words). Sentences without such words are left out.
    """
    out = []
    for sentence in _SENTENCE.split(unit):
        if lang == "de" or sentence.isupper():
            words = _WORD.findall(sentence.lower())
        else:
            words = _SMALL_WORD.findall(sentence)
            if words:
                words[0] = words[0].lower()
        if words:
            out.append(words)
    return out


def language_of(text: str | None) -> str:
    """en, de or fr, by telling words of the text; en if there are none."""
    low = (text or "").lower()
    counts = {lang: sum(low.count(w) for w in telling) for lang, telling in _TELLING.items()}
    return max(counts, key=lambda k: (counts[k], k == "en"))
