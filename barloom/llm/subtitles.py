"""Subtitle texts as words by cue: markup, sound descriptions, notes, adverts and credits taken out, wrong encodings undone."""

from __future__ import annotations

import re

CUE, DOC, LINE = "\x01", "\x02", "\x03"

# Beginnings of adverts and credits (synced by, downloaded from, support and remove ads) in the languages that occur.
CREDITS = [
    "synced and corrected", "subtitles downloaded", "and become a member to remove",
    "bearbeitet von", "untertitel von", "und entferne alle werbung",
    "synchronisé et corrigé", "sous-titres téléchargés", "et supprimez les publicités",
    "sincronizado y corregido", "subtítulos descargados", "y elimina los anuncios",
    "sincronizado e corrigido", "legendas baixadas", "e remova os anúncios",
    "sincronizzato e corretto", "sottotitoli scaricati", "e rimuovi la pubblicità",
    "gesynchroniseerd en verbeterd", "ondertitels gedownload", "en verwijder alle reclame",
    "synkad och rättad", "undertexter hämtade", "och slipp all reklam",
    "synkroniseret og rettet", "undertekster hentet", "og slip for reklamer",
    "synchronizacja i korekta", "napisy pobrane", "i usuń wszystkie reklamy",
    "çeviri ve düzeltme", "adresinden indirildi", "sitesini destekleyin",
    "перевод и правка", "субтитры скачаны", "и уберите рекламу",
    "переклад і редагування", "субтитри завантажено", "і приберіть рекламу",
]


# A phrase of which only question marks are left counts together with one of these.
_NAMES = ["www.", "http:", "https:", ".example", ".com ", " crew ", " team "]
# A web address is no word of any language; what is said around it stays.
_ADDRESS = re.compile(r"https?://\S+|www\.\w[\w-]*\.\w\S*")
# A time line, the number before it included.
_TIME_LINE = re.compile(r"\n[\s\ufeff0-9OoIl:.,]*-->[^\n\x02]*")
_MARKUP = re.compile(r"<[^>\n]*>|\{[^}\n]*\}|\[[^\]\x01\x02]*\]|\([^)\x01\x02]*\)|\*[^*\x01\x02]*\*|[♪♫][^♪♫\n\x01\x02]*[♪♫]")
# A speaker's name in capitals before what is said.
_SPEAKER = re.compile(r"\n(?:[ \t-]|<[^>\n]*>|\{[^}\n]*\})*[A-ZÀ-ÞА-ЯЁІЇЄҐ][A-ZÀ-ÞА-ЯЁІЇЄҐ .]+:")
# Letters that a Cyrillic text in a one-byte code page becomes when it is read as a western one.
_HIGH = re.compile(r"[À-ÿ¸¨³²ºª¿¯´¥¹¾¼½]{3,}")
_SHORT = re.compile(r"\b[À-ÿ³]{1,2}\b")
_PAIR = re.compile(r"[ÂÃÄÅÐÑ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ\ufffd]")
_AS_CYRILLIC = {c: bytes([c]).decode("cp1251", "replace") for c in range(0xA1, 0x100)}
_AS_BYTES = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _as_read(phrase: str) -> set[str]:
    """The phrase, and what wrong encodings leave of it where they cannot be undone: western letters, question marks, or letters left out."""
    found = {phrase}
    for p in (phrase, phrase.capitalize()):
        for code in ("cp1250", "cp1251", "cp1254"):
            try:
                found.add(p.encode(code).decode("cp1252", "replace").lower())
            except UnicodeEncodeError:
                continue
        found.add(p.encode("latin-1", "replace").decode("latin-1").lower())
        found.add(p.encode().decode("cp1252", "ignore").translate(_AS_BYTES).encode("latin-1", "ignore").decode("utf-8", "ignore").lower())
    return found


_PHRASES = sorted({x for c in CREDITS for x in _as_read(c)})


def undo_encoding(text: str) -> str:
    """A text whose UTF-8 was read as western letters, or whose one-byte Cyrillic was, as it was meant. Others come back as they are."""
    if any(c in text for c in "ÃÐÑÅÄÂ"):
        pairs = len(_PAIR.findall(text))
        if pairs >= 3 or pairs and pairs * 2 > len(re.findall(r"[À-ÿ]", text)):
            return text.translate(_AS_BYTES).encode("latin-1", "ignore").decode("utf-8", "ignore")
    if any(c in text for c in "îàåíÎÀÅÍ") and len(_HIGH.findall(text)) >= 3:
        to = lambda m: m.group().translate(_AS_CYRILLIC)
        return _HIGH.sub(to, _SHORT.sub(to, text))
    return text


def tokens_of(texts: list[str]) -> list[str]:
    """The dialogue of all texts in order, lower-cased and split at blanks; DOC ends a text, CUE begins a cue. Punctuation stays at its word."""
    joined = f" {DOC} \n".join(["", *[undo_encoding(t.replace(CUE, " ").replace(DOC, " ")) for t in texts]])[len(DOC) + 2 :]
    joined = joined.replace("\r\n", "\n").replace("\r", "\n")
    joined = _MARKUP.sub(" ", _SPEAKER.sub("\n", _TIME_LINE.sub(f" {CUE}", joined))).lower()
    joined = joined.replace("  ", " ").replace("  ", " ").replace(" \n", "\n").replace("\n ", "\n")
    return _ADDRESS.sub(" ", _without_adverts(joined)).replace("\n", f" {LINE} ").split()


def _without_adverts(joined: str) -> str:
    """`joined` without the cues that hold an advert or a credit. Of text that is in no cue only the lines that hold one go."""
    flat = joined.replace("\n", " ")  # a credit may be wrapped anywhere
    spans = []
    for phrase in _PHRASES:
        at = flat.find(phrase)
        while at >= 0:
            after = at + len(phrase)
            doc = flat.rfind(DOC, 0, at)
            cue = flat.rfind(CUE, doc + 1, at)
            ends = [flat.find(CUE, after), flat.find(DOC, after)]
            if cue < 0:
                cue = max(joined.rfind("\n", doc + 1, at), doc)
                ends.append(joined.find("\n", after))
            end = min((e for e in ends if e >= 0), default=len(joined))
            if set(phrase) != {"?", " "} or any(n in flat[cue + 1 : end] + " " for n in _NAMES):
                spans.append((cue + 1, end))
            at = flat.find(phrase, end)
    out, done = [], 0
    for start, end in sorted(spans):
        out.append(joined[done:start])
        done = max(done, end)
    return " ".join([*out, joined[done:]])


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def words_in(token: str) -> list[str]:
    return _WORD.findall(token)
