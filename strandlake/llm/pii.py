"""Personal data by weak supervision.

Candidates come from strict patterns (the base spans, which always stay) and from looser ones: addresses spelt out, local phone numbers, national ids, bank accounts,
names of persons, streets with a number. Persons are found by titles and given names, by words that introduce one ("Dear", "name:"), and by a gazetteer that is learned from all
documents: first and last words of names that a title or such a word introduced in several documents, as a table of bits of fixed size. Four labelers vote on each candidate:
its format (patterns, check digits, shape of the words), gazetteers (domains, calling codes, card issuers, account lengths, names, street words), the words around it, and its borders. The votes and a few features of each candidate form a pattern; patterns are counted over
all documents, and expectation-maximisation on the counts estimates for each kind how often it is personal and how reliable each labeler is. A logistic classifier is trained
on the resulting probabilities and decides which of the looser candidates are spans as well. Its features are none of the votes, nor what a vote is made of.

Everything that leaves the executors is the table of patterns. Its size is bounded by the product of the kinds, votes and feature values
(MAX_PATTERNS), whatever the size of the corpus.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import slices, with_arrow_columns

#: Kinds in the order of the results; the first four have base spans.
KINDS = ("email", "ip", "card", "phone", "email_words", "phone_local", "national_id", "iban", "name", "address")
BASE = KINDS[:4]
LABELERS = ("format", "gazetteer", "context", "borders")

# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

RUN = re.compile(r"[0-9]+")
PHONE_LOCAL = re.compile(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
NATIONAL_ID = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
AT_WORD = re.compile(r" ?[\[(]at[\])] ?")
AFTER_AT = re.compile(r"[A-Za-z0-9-]++ ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,10}")
BEFORE_AT = LOCAL - frozenset("%+")

IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NAME_TAIL = re.compile(r"\.?(?: [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'-]+){1,2}")
NAME_PAIR = re.compile(r"(?<![\w'-])[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'-]+(?: [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'-]+){1,2}")
TITLE_AFTER = re.compile(r"\.? ")
NAME_AFTER = re.compile(r"(?::|,)? {1,2}(?=[A-ZÀ-ÖØ-Þ])")
NUMBER_BEFORE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?,?(?: [A-ZÀ-ÖØ-Þ][\w.'-]*){1,3} $")
NUMBER_AFTER = re.compile(r"(?: (?:de|du|des|la|le|del|los|las))*(?: [A-ZÀ-ÖØ-Þ][\w'-]+){1,3},? [0-9]{1,5}(?![0-9A-Za-z])")
HOUSE_AFTER = re.compile(r" [0-9]{1,4}[a-z]?(?![0-9A-Za-z])")

# The gazetteers.
TOP_DOMAINS = frozenset("""com org net edu gov mil int info biz name pro io co ai app dev me tv xyz online site shop blog cloud eu
uk ie fr de at ch li nl be lu es pt it gr mt cy dk se no fi is ee lv lt pl cz sk hu ro bg hr si rs ba mk al ua by md ru ge am az tr
us ca mx gt cu do cr pa br ar cl pe ve ec bo py uy au nz jp cn hk tw kr in pk bd lk np th vn my sg id ph il ae sa qa kw ir iq eg ma dz tn ng ke gh za""".split())
#: Calling codes of one and two digits, and the first two digits of those of three.
CALLING_SHORT = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CALLING_LONG = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: Characters of an account number by country.
ACCOUNTS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GE": 22,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "KW": 30, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29,
}
HONORIFICS = frozenset("Mr Mrs Ms Miss Dr Prof Sir Herr Frau Señor Señora Sr Sra Don Doña Monsieur Madame Mme Mlle".split())
#: Words that a name follows.
INTRODUCED = frozenset("name Name named regards Regards sincerely Sincerely Dear dear signed Signed contact Contact geehrte geehrter Grüße cordialement Cordialement nombre Nombre saludos Saludos Patient Customer".split())
GIVEN = frozenset("""James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Nancy Daniel Lisa Matthew Betty Anthony Margaret Mark Sandra
Hans Peter Klaus Jürgen Wolfgang Stefan Andreas Markus Ursula Monika Sabine Petra Claudia Katharina Brigitte Heike Jean Pierre Michel Philippe Jacques Nicolas François Marie Nathalie Isabelle Sylvie Catherine Sophie Camille
José Antonio Manuel Francisco Juan Javier Carlos Miguel Alejandro Pedro Carmen María Isabel Dolores Pilar Teresa Lucía Elena Cristina Laura""".split())
SURNAMES = frozenset("""Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Bernard Dubois Durand Moreau Laurent Simon Lefebvre Leroy Roux Fournier
García González Rodríguez Fernández López Martínez Sánchez Pérez Gómez Ruiz Hernández Díaz Moreno Muñoz Álvarez Romero Alonso Gutiérrez Navarro Torres""".split())
STREETS_LAST = frozenset("Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct Square Terrace Parkway Highway".split())
STREETS_FIRST = frozenset("Rue Avenue Boulevard Place Quai Impasse Calle Avenida Plaza Paseo Camino Carretera".split())
STREETS_END = ("straße", "strasse", "gasse", "platz", "allee")

NEAR = 40
CUES = {
    "email": ("mail", "contact", "write", "reach", "kontakt", "schreib", "correo", "escrib", "courriel", "adresse"),
    "ip": ("ip", "host", "server", "address", "login", "router", "gateway", "servidor", "serveur"),
    "card": ("card", "visa", "credit", "debit", "payment", "expir", "karte", "zahlung", "carte", "paiement", "tarjeta", "pago"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "anruf", "handy", "appel", "portable", "llam", "móvil"),
    "national_id": ("ssn", "social", "tax", "passport", "identity", "ausweis", "steuer", "identité", "seguridad", "dni"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "überweis", "compte", "virement", "cuenta", "transferencia"),
    "name": ("name", "dear", "regards", "sincerely", "signed", "contact", "born", "grüße", "geehrte", "cordialement", "nombre", "saludos", "patient", "customer"),
    "address": ("address", "live", "street", "zip", "postal", "ship", "deliver", "home", "wohn", "adresse", "habite", "domicilio", "dirección", "vive"),
}
CUES |= {"email_words": CUES["email"], "phone_local": CUES["phone"]}
AGAINST = ("version", "isbn", "order", "invoice", "sha", "build", "serial", "chapter", "figure")

#: kinds * 3 votes of 4 labelers * features (length, separators, what stands before, share of digits, first character)
FEATURES = (4, 4, 3, 4, 4)
MAX_PATTERNS = len(KINDS) * 3 ** len(LABELERS) * int(np.prod(FEATURES))


#: Bits of the learned gazetteer; documents in which a word must have been introduced.
NAME_BITS, NAME_DOCS = 1 << 20, 3


def _bit(role: str, word: str) -> int:
    """A word's place in the learned gazetteer, by the role (first or last) it has in a name."""
    return zlib.crc32(f"{role}{word}".encode()) % NAME_BITS


def _knows(names: np.ndarray | None, role: str, word: str) -> bool:
    """Whether the learned gazetteer (packed bits) has a word."""
    return names is not None and bool(names[(b := _bit(role, word)) >> 3] >> (b & 7) & 1)


@lru_cache(maxsize=1)
def _gazetteer():
    """One automaton for all words of names and streets."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in HONORIFICS | INTRODUCED | GIVEN | STREETS_LAST | STREETS_FIRST | {*STREETS_END}:
        a.add_word(w, w)
    a.make_automaton()
    return a


def named(text: str, names: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Candidates (kind, start, end): persons and streets with a number, leftmost and non-overlapping for each kind.

    Words of the fixed gazetteers lead to them, and pairs of words that the learned one has as first and last words of names.
    """
    out, people, street_end = [], [], 0
    if names is not None:
        for m in NAME_PAIR.finditer(text):
            words = m[0].split(" ")
            if _knows(names, "first", words[0]) and _knows(names, "last", words[-1]):
                people.append(m.span())
    for last, w in _gazetteer().iter(text):
        end, start = last + 1, last + 1 - len(w)
        if end < len(text) and text[end].isalnum():
            continue
        first = start
        while first > 0 and text[first - 1].isalpha():
            first -= 1
        if w in STREETS_END:
            if first >= street_end and text[first].isupper() and (m := HOUSE_AFTER.match(text, end)):
                street_end = m.end()
                out.append((9, first, street_end))
            continue
        if first < start or start > 0 and text[start - 1].isalnum():
            continue
        if (w in HONORIFICS or w in GIVEN) and (m := NAME_TAIL.match(text, end)):
            people.append((start, m.end()))
        elif w in INTRODUCED and (m := NAME_AFTER.match(text, end)) and (m := NAME_PAIR.match(text, m.end())):
            people.append(m.span())
        if w in STREETS_LAST and start >= street_end and (m := NUMBER_BEFORE.search(text[max(street_end, start - 60) : start])):
            out.append((9, max(street_end, start - 60) + m.start(), end))
            street_end = end
        elif w in STREETS_FIRST and start >= street_end and (m := NUMBER_AFTER.match(text, end)):
            street_end = m.end()
            out.append((9, start, street_end))
    name_end = 0
    for start, end in sorted(people, key=lambda x: (x[0], -x[1])):
        if start >= name_end:
            name_end = end
            out.append((8, start, end))
    return out


def introduced(text: str) -> set[int]:
    """Bits of the first and last words of names that a title or an introducing word stands before."""
    out = set()
    for last, w in _gazetteer().iter(text):
        end = last + 1
        if (w in HONORIFICS or w in INTRODUCED) and not text[last - len(w) : last + 1 - len(w)].isalnum():
            m = TITLE_AFTER.match(text, end) if w in HONORIFICS else NAME_AFTER.match(text, end)
            if m and (m := NAME_PAIR.match(text, m.end())):
                words = [x for x in m[0].split(" ") if x not in HONORIFICS]
                if words:
                    out.add(_bit("last", words[-1]))
                if len(words) > 1:
                    out.add(_bit("first", words[0]))
    return out


def account(span: str) -> bool:
    """Whether the check digits of an account number are right."""
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails_in_words(text: str) -> list[tuple[int, int, int]]:
    """Addresses like joe [at] web [dot] org: found by what stands for the at sign, so that a long run of letters is walked over once."""
    out, low = [], 0
    for at in AT_WORD.finditer(text):
        i = at.start()
        while i > low and text[i - 1] in BEFORE_AT and not (text[i - 1] == "." and text[i : i + 1] in (".", " ", "(", "[")):
            i -= 1
        if text[i : i + 1] == ".":
            i += 1
        if i < at.start() and (m := AFTER_AT.match(text, at.end())):
            low = m.end()
            out.append((4, i, low))
    return out


def candidates(text: str, names: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans (kind, start, end): strict matches, leftmost and non-overlapping for each kind; and looser ones that overlap none.

    Patterns of digits are tried only where a run of digits starts: a match that could start inside a run would start at its first digit.
    """
    base, more = [], []
    if "@" in text:
        low, at = 0, text.find("@")
        while at >= 0:
            i = at
            while i > low and text[i - 1] in LOCAL:
                i -= 1
            if i < at and (m := DOMAIN.match(text, at + 1)):
                low = m.end()
                base.append((0, i, low))
            at = text.find("@", at + 1)
    ip_end = card_end = more_end = 0
    for run in RUN.finditer(text):
        at, end = run.span()
        if at >= ip_end and text[end : end + 1] == "." and (m := IP.match(text, at)):
            ip_end = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                base.append((1, at, ip_end))
        if at >= card_end and (m := CARD.match(text, at)):
            card_end = m.end()
            if card_end - at >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                base.append((2, at, card_end))
        if end - at >= 2 and at >= 2 and at >= more_end and text[at - 1].isupper() and not text[at - 3 : at - 2].isalnum() and (m := IBAN.match(text, at - 2)):
            more_end = m.end()
            more.append((7, at - 2, more_end))
        elif end - at == 3 and at >= more_end:
            if m := PHONE_LOCAL.match(text, at):
                more_end = m.end()
                more.append((5, at - (text[at - 1 : at] == "("), more_end))
            elif (m := NATIONAL_ID.match(text, at)) and text[at - 1 : at] != "-":
                more_end = m.end()
                more.append((6, at, more_end))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                base.append((3, *m.span()))
    if "at)" in text or "at]" in text:
        more += emails_in_words(text)
    more += named(text, names)
    if base and more:
        # of the base spans that start before a candidate ends, the furthest end
        spans = sorted((s, e) for _, s, e in base)
        furthest = np.maximum.accumulate([0, *(e for _, e in spans)]).tolist()
        more = [x for x in more if furthest[bisect_left(spans, (x[2],))] <= x[1]]
    return base, more


def _calling(digits: str) -> bool:
    return digits[:1] in CALLING_SHORT or digits[:2] in CALLING_SHORT or digits[:2] in CALLING_LONG


def pattern(text: str, kind: int, start: int, end: int, names: np.ndarray | None = None) -> int:
    """Votes and features of a candidate as one number."""
    name, span = KINDS[kind], text[start:end]
    digits = _digits(span)
    if kind in (0, 4):
        form = 1 if ".." not in span and not span.startswith((".", "-")) else 2
        words = 1 if re.split(r"[.\s\])]", span)[-1].lower() in TOP_DOMAINS else 2
    elif kind == 1:
        form = 2 if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 1
        words = 2 if span.startswith(("0.", "127.", "255.")) else 0
    elif kind == 2:
        form = 1 if digits[0] in "3456" else 2
        words = 1 if (digits[0], len(digits)) in {("3", 15), ("4", 13), ("4", 16), ("4", 19), ("5", 16), ("6", 16), ("6", 19)} else 2
    elif kind == 6:
        form = 2 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
        words = 0
    elif kind == 7:
        form = 1 if account(span) else 2
        words = 1 if ACCOUNTS.get(span[:2]) == len(span.replace(" ", "")) else 2
    elif kind == 8:
        parts = span.replace(".", "").split(" ")
        form = 1 if all(2 <= len(p) <= 12 and p[-1].isalpha() for p in parts) and not re.search(r"([a-zß-öø-ÿ])\1\1", span) else 2
        words = 1 if parts[0] in HONORIFICS or parts[-1] in SURNAMES or _knows(names, "last", parts[-1]) and (parts[0] in GIVEN or _knows(names, "first", parts[0])) else 2
    elif kind == 9:
        form = 1 if digits[0] != "0" else 2
        words = 1 if any(w in STREETS_LAST or w in STREETS_FIRST or w.endswith(STREETS_END) for w in re.split("[ ,]+", span) if len(w) > 3) else 0
    else:
        form = 1 if span.count("(") == span.count(")") and "  " not in span and 10 <= len(digits) else 2
        words = (1 if _calling(digits) else 2) if kind == 3 else (2 if digits[0] in "01" else 1)
    around = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
    cue = 1 if any(c in around for c in CUES[name]) else 2 if any(c in around for c in AGAINST) else 0
    borders = 2 if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum() else 1
    length = min(3, max(0, (end - start - 8) // 6))
    separators = (1 if any(c in span for c in " ().") else 0) + (2 if "-" in span else 0)
    before = text[max(0, start - 2) : start].strip()[-1:]
    stands = 0 if not before else 1 if before in ":=#" else 2
    share = min(3, 4 * len(digits) // len(span))
    first = 0 if span[0].isdigit() else 1 if span[0].isupper() else 2 if span[0].isalpha() else 3
    out = kind
    for value, of in zip((form, words, cue, borders, length, separators, stands, share, first), (3, 3, 3, 3, *FEATURES)):
        out = out * of + value
    return out


def _parts(code: int) -> tuple[int, list[int], list[int]]:
    """kind, votes (0 none, 1 for, 2 against), features of a pattern."""
    values = []
    for of in (*reversed(FEATURES), 3, 3, 3, 3):
        code, v = divmod(code, of)
        values.append(v)
    values.reverse()
    return code, values[:4], values[4:]


def _row(code: int) -> np.ndarray:
    """One-hot features of a pattern, with an intercept; votes are not among them."""
    kind, _, feats = _parts(code)
    x = np.zeros(1 + len(KINDS) + sum(FEATURES))
    x[0] = x[1 + kind] = 1
    at = 1 + len(KINDS)
    for v, of in zip(feats, FEATURES):
        x[at + v] = 1
        at += of
    return x


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation for candidates of one kind with these votes (0 none, 1 for, 2 against), n of each.

    Returns how likely each is personal, the share of all, and how often each labeler gives each vote where it isn't and where it is. Starts from the majority.
    The priors stand for ten candidates, half of them personal, on which a labeler is right in eight of ten votes.
    """
    q = 1 / (1 + np.exp(-1.0 * ((votes == 1).sum(1) - (votes == 2).sum(1))))
    for _ in range(rounds):
        prior = (q @ n + 5) / (n.sum() + 10)
        table = np.array([[np.bincount(votes[:, j], w * n, 3) + right for j in range(votes.shape[1])] for w, right in ((1 - q, (1.0, 1.0, 8.0)), (q, (1.0, 8.0, 1.0)))])
        table /= table.sum(2, keepdims=True)
        score = np.log(prior / (1 - prior)) + sum(np.log(table[1, j, votes[:, j]] / table[0, j, votes[:, j]]) for j in range(votes.shape[1]))
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return q, float(prior), table


def fit(counts: dict[int, int], rounds: int = 50) -> tuple[np.ndarray, dict]:
    """Weights of the span classifier, and the estimated reliabilities, from the number of candidates of each pattern."""
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    kinds = np.array([_parts(c)[0] for c in codes], int)
    votes = np.array([_parts(c)[1] for c in codes], int).reshape(-1, len(LABELERS))
    p = np.full(len(codes), 0.5)
    told: dict = {}
    for kind in range(len(KINDS)):
        k = np.flatnonzero(kinds == kind)
        if len(k):
            p[k], prior, table = reliabilities(votes[k], n[k], rounds)
            told[KINDS[kind]] = {"share": prior, **{name: [float(table[1, j, 1]), float(table[0, j, 2])] for j, name in enumerate(LABELERS)}}
    w = np.zeros(len(_row(0)))
    if codes:
        x = np.array([_row(c) for c in codes])
        for _ in range(25):  # Newton steps on the penalised likelihood
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (p - q)) - w
            step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + np.eye(len(w)), grad)
            w = w + step / max(1.0, np.abs(step).max() / 2)
    return w, told


def learn_names(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The gazetteer (packed bits) of words that are introduced as first or last words of names in at least NAME_DOCS of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(NAME_BITS, np.int64)
        for whole in batches:
            for b in slices(whole, text):
                for t in b.column(text).to_pylist():
                    if t:
                        seen[list(introduced(t))] += 1
        bits = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64()), pa.array(seen[bits], pa.int64())], names=["bit", "n"])

    known = docs.select(text).mapInArrow(run, "bit long, n long").groupBy("bit").agg(F.sum("n").alias("n")).where(F.col("n") >= NAME_DOCS)
    bits = np.zeros(NAME_BITS, bool)
    bits[[r.bit for r in known.select("bit").collect()]] = True  # at most NAME_BITS rows
    return np.packbits(bits, bitorder="little")


def count_patterns(docs: DataFrame, text: str = "text", names: np.ndarray | None = None) -> DataFrame:
    """(pattern, n): how many candidates of all documents have each pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for whole in batches:
            for b in slices(whole, text):
                for t in b.column(text).to_pylist():
                    for spans in candidates(t or "", names):
                        for s in spans:
                            code = pattern(t, *s, names)
                            seen[code] = seen.get(code, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    return docs.select(text).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


class Model(NamedTuple):
    """Weights of the span classifier, and the learned gazetteer of names."""

    weights: np.ndarray
    names: np.ndarray | None = None


def find_spans(text: str, model: Model | np.ndarray) -> list[tuple[int, int, int, bool]]:
    """All spans (kind, start, end, whether base) by kind, then start."""
    weights, names = model if isinstance(model, Model) else Model(model)
    base, more = candidates(text, names)
    out = [(*s, True) for s in base]
    out += [(*s, False) for s in more if _row(pattern(text, *s, names)) @ weights >= 0]
    return sorted(out)


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """text with each span replaced by its kind in brackets; spans that overlap are replaced together, under the first one's kind."""
    out, at = [], 0
    for k, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def train(docs: DataFrame, text: str = "text") -> tuple[Model, dict]:
    """The model, and the estimated reliabilities by kind, from all rows of docs (repeated ones count each; null and empty texts hold no candidates; an empty table gives a model
    that keeps no looser span). Long texts are searched in time that grows with their length."""
    names = learn_names(docs, text)
    weights, told = fit({r.pattern: r.n for r in count_patterns(docs, text, names).collect()})  # at most MAX_PATTERNS rows
    return Model(weights, names), told


def detect(docs: DataFrame, weights: Model | np.ndarray, text: str = "text", redact: bool = False, column: str = "pii_spans") -> DataFrame:
    """docs with pii_spans, or another column (kind, start, end in code points, base), and with the text redacted if asked.

    Null and empty texts have no spans (null stays null). Rows are taken one by one: repeated rows have equal results; texts are searched whole, in time that
    grows with their length. An empty table gives no rows. Columns of docs with the name of a new one are replaced.
    """
    fields = [T.StructField(column, SPAN)]
    if redact:
        fields.append(T.StructField(text, T.StringType()))

    def make():
        def f(texts):
            found = [find_spans(t or "", weights) for t in texts]
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in x] for x in found]
            return [spans, [t and redacted(t, x) for t, x in zip(texts, found)]] if redact else [spans]

        return f

    return with_arrow_columns(docs, text, fields, make)


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x.kind == kind)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query, from pii_spans."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    base = F.filter("pii_spans", lambda x: x.base)
    counts = [F.size(_of_kind(base, k)).cast("long").alias(f"n_{k}") for k in BASE]
    return docs.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
