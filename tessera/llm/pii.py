"""Personal data: base patterns, and further spans by weak supervision.

One scan finds, per text, the base spans (email, ip, card, phone) and candidates: the
base spans, base look-alikes that failed their check, and looser shapes (emails
spelled out, phones without a country code, IBANs, social security numbers, access
keys, secrets assigned to a name, names after a title, street addresses).  Four
labelers vote on each candidate, +1, -1 or 0 for no opinion:

* ``shape``: a strict pattern of the kind;
* ``check``: a checksum, range or entropy (Luhn, mod 97, octets, known prefixes, bits a character);
* ``gazetteer``: a list of words that belong to the kind or speak against it;
* ``context``: a cue word within 40 characters before the span.

Counts by (kind, votes, features of the span: length, entropy, share of digits, kinds of
characters, a capital at its start) are summed over all documents; that table is
bounded by the number of patterns.  Expectation-maximisation on it estimates how
often each labeler is right, a logistic classifier is fitted to the resulting
probabilities, and candidates it accepts are added.  Base spans always stay.

Defined cases: a null or empty text has no span; offsets are code points, end
exclusive; overlapping added spans of one kind keep the leftmost; an added span that
overlaps a base span is dropped; every pattern runs in time linear in the text, however
long; each row, repeated or without an id, is judged by its own text; columns besides id and
text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of
from tessera.session import cut_lineage

BASE = ("email", "ip", "card", "phone")
ADDED = ("email_text", "phone_local", "iban", "ssn", "access_key", "secret", "name", "street")
LABELERS = ("shape", "check", "gazetteer", "context")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run that fails at its start fails further on as well; matches end at a run's end
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._-])([A-Za-z0-9._-]{2,64}) ?[\[(] ?(?:at|AT) ?[\])] ?([A-Za-z0-9-]{2,63}) ?[\[(] ?(?:dot|DOT) ?[\])] ?([A-Za-z]{2,10})\b")
_LOCAL_PHONE = re.compile(r"(?<![\w+.()-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
# fixed values: prefixes of issued keys, and the lengths that follow them
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+"
                  r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9])")
_KEY_HINTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "_live_", "_test_", "AIza", "eyJ")
_ASSIGNED = re.compile(r"[:=]")
_SECRET_NAME = re.compile(r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credentials?)"
                          r"[\"']?[ \t]{0,3}$", re.I)
_SECRET_VALUE = re.compile(r"[ \t]{0,3}[\"']?([A-Za-z0-9+/_.~!@#$%^&*=-]{8,}+)")
_NAME = re.compile(r"(?<![^\W_])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.? "
                   r"([A-ZÄÖÜÉÈÁÍÓÚÑ][a-zäöüßéèêáíóúñç'’-]{1,30}(?: [A-ZÄÖÜÉÈÁÍÓÚÑ][a-zäöüßéèêáíóúñç'’-]{1,30}){0,2})")
_TITLES = ("Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Sr")
_WORD = r"[A-ZÄÖÜÉÈÁÍÓÚÑ][\w'’-]{1,30}"
_STREET = re.compile(rf"(?<![\w.,-])[0-9]{{1,5}}[a-z]? (?:{_WORD} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square)\b\.?"
                     rf"|(?<![^\W_])[A-ZÄÖÜ][\w-]{{1,30}}(?:straße|strasse|weg|platz|gasse|allee) [0-9]{{1,4}}[a-z]?\b"
                     rf"|(?<![\w.,-])[0-9]{{1,4}}(?: ?bis)?,? (?:rue|avenue|boulevard|place) (?:(?:de|du|des|la|le|les) ){{0,2}}{_WORD}(?: {_WORD})?"
                     rf"|(?<![^\W_])(?:Calle|Avenida|Plaza|Paseo) (?:(?:de|del|la|las|los) ){{0,2}}{_WORD}(?: {_WORD})?,? (?:n[º°.] ?)?[0-9]{{1,4}}\b")
_PLACEHOLDER = re.compile(r"example|changeme|placeholder|your|dummy|sample|redacted|x{4}|\*{3}|password|secret|none|null|true|false", re.I)
_NOT_NAMES = frozenset("Monday Tuesday Wednesday Thursday Friday Saturday Sunday The And But This That Montag Dienstag Lundi Lunes President Minister".split())
_FIRST_NAMES = frozenset("""James John Robert Michael William David Richard Thomas Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jane Sarah Anna
Peter Hans Klaus Wolfgang Jürgen Stefan Andreas Ursula Monika Petra Sabine Jean Pierre Jacques Philippe Marie Nathalie Isabelle Sophie
José Juan Carlos Luis Miguel Antonio María Carmen Ana Isabel Laura Daniel Paul Maria Martin""".split())
_CUES = {
    "access_key": "key aws access secret token credential credentials api clé schlüssel clave",
    "secret": "password passwd passphrase pwd secret token key credential credentials login",
    "name": "name signed sincerely dear contact patient born from by nom nombre gruß", "street": "address live lives lived living at street ship office adresse dirección anschrift wohnt",
    "email": "mail contact write reach courriel correo", "ip": "ip server host address client login",
    "card": "card visa credit payment paid karte carte tarjeta", "phone": "phone tel call mobile fax cell telefon",
    "iban": "iban account bank konto compte cuenta transfer", "ssn": "ssn social security insurance"}
CUES = {k: re.compile(r"\b(?:" + "|".join(v.split()) + r")\b", re.I) for k, v in _CUES.items()}
AGAINST = re.compile(r"\b(?:version|section|chapter|isbn|doi|figure|page|order|invoice|release)\b", re.I)
COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MT NL NO PL PT RO SE SI SK".split())
TLDS = frozenset("com org net edu gov info io de fr es uk eu it nl ch at".split())


def _bits(text: str) -> float:
    """Entropy of the characters, in bits a character."""
    n = len(text)
    return math.log2(n) - sum(c * math.log2(c) for c in Counter(text).values()) / n


def _looks(text: str) -> str:
    """Features of a span: entropy, share of digits, kinds of characters, a capital at its start."""
    digits = sum(c.isdigit() for c in text)
    kinds = any(c.islower() for c in text) + any(c.isupper() for c in text) + (digits > 0) + any(not c.isalnum() for c in text)
    return f"{min(3, int(_bits(text)) if text else 0)}{min(3, 4 * digits // max(1, len(text)))}{max(0, kinds - 1)}{int(text[:1].isupper())}"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in text.split(".")))


def _mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def base_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """Leftmost matches of each base pattern, and whether each passes its check."""
    out, last, seen, p = [], 0, 0, text.find("@")
    while p >= 0:
        before = text[max(last, seen):p]
        start = p - (len(before) - len(before.rstrip(_LOCAL)))
        if start < p and (m := _DOMAIN.match(text, p + 1)):
            out.append(("email", start, m.end(), True))
            last = m.end()
        seen = p + 1
        p = text.find("@", max(seen, last))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span(), _octets(m[0])) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        n = m.end() - m.start()
        if n >= 7:  # shorter runs are no look-alike either
            digits = m[0].replace(" ", "").replace("-", "")
            out.append(("card", *m.span(), 13 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        out += [("phone", *m.span(), 9 <= len(_DIGITS.sub("", m[0])) <= 15) for m in _PHONE.finditer(text)]
    return out


def _votes(kind: str, text: str, start: int, end: int, passed: bool) -> tuple[int, ...]:
    span, before = text[start:end], text[max(0, start - 40):start]
    about = {"email_text": "email", "phone_local": "phone"}.get(kind, kind)
    digits = _DIGITS.sub("", span) if end - start < 200 else ""
    shape = check = word = 0
    if kind in BASE:
        check = 1 if passed else -1
        shape = 1 if 6 <= end - start <= 64 else -1
        if kind == "email":
            word = 1 if span.rpartition(".")[2].lower() in TLDS else 0
    elif kind == "email_text":
        tld = span.rstrip(")] ").rpartition(" ")[2].rpartition(")")[2].rpartition("]")[2].lower()
        shape, word = 1, 1 if tld in TLDS else -1
    elif kind == "phone_local":
        shape, check = (1 if "(" in span or "-" in span else -1), (1 if digits[0] in "23456789" and digits[3] in "23456789" else -1)
    elif kind == "iban":
        shape, check, word = 1, 1 if _mod97(span) else -1, 1 if span[:2] in COUNTRIES else -1
    elif kind == "ssn":
        shape, check = 1, -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "access_key":
        shape, check = 1, 1 if _bits(span) >= 3 else -1
        word = -1 if _PLACEHOLDER.search(span) else 1
    elif kind == "secret":
        mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
        shape, check = 1 if mixed else -1, 1 if _bits(span) >= 2.75 else -1
        word = -1 if _PLACEHOLDER.search(span) else 0
    elif kind == "name":
        parts = span.split(" ")
        shape, check = 1 if len(parts) > 1 else 0, -1 if any(p in _NOT_NAMES for p in parts) else 1
        word = 1 if parts[0] in _FIRST_NAMES else 0
    elif kind == "street":
        shape, check = 1, -1 if digits.startswith("0") else 1
        word = 1 if "," in text[end:end + 2] else 0
    context = 1 if CUES[about].search(before) else -1 if AGAINST.search(before) else 0
    return shape, check, word, context


def _secrets(text: str):
    """Values assigned to a name that says it is a secret, from the left, without overlaps."""
    last = 0
    for m in _ASSIGNED.finditer(text):
        p = m.start()
        if p >= last and _SECRET_NAME.search(text, max(0, p - 24), p) and (value := _SECRET_VALUE.match(text, p + 1)):
            last = value.end()
            yield value.span(1)


def _apart(spans: list, base: list) -> list:
    """Spans that meet no base span."""
    base = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in base], list(itertools.accumulate((b for _, b in base), max))
    return [x for x in spans if not (i := bisect.bisect_left(starts, x[2])) or reach[i - 1] <= x[1]]


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str]]]:
    """Base spans, and all candidates as (kind, start, end, pattern)."""
    found = base_matches(text)
    base = [(k, a, b) for k, a, b, ok in found if ok]
    more = []
    if "dot" in text or "DOT" in text:
        more += [("email_text", *m.span(), True) for m in _SPELLED.finditer(text)]
    if found or _DIGIT.search(text):
        more += [("phone_local", *m.span(), True) for m in _LOCAL_PHONE.finditer(text)]
        more += [("iban", *m.span(), True) for m in _IBAN.finditer(text)]
        if "-" in text:
            more += [("ssn", *m.span(), True) for m in _SSN.finditer(text)]
    if any(h in text for h in _KEY_HINTS):
        more += [("access_key", *m.span(), True) for m in _KEY.finditer(text)]
    if "=" in text or ":" in text:
        more += [("secret", a, b, True) for a, b in _secrets(text)]
    if any(h in text for h in _TITLES):
        more += [("name", *m.span(1), True) for m in _NAME.finditer(text)]
    if _DIGIT.search(text):
        more += [("street", *m.span(), True) for m in _STREET.finditer(text)]
    if more and base:
        more = _apart(more, base)
    out = []
    for kind, a, b, ok in found + more:
        votes = _votes(kind, text, a, b, ok)
        size = min(3, (b - a).bit_length() // 2)
        out.append((kind, a, b, f"{kind}|{','.join(map(str, votes))}|{size}|{_looks(text[a:b])}"))
    return base, out


def _scan(batches):
    kinds = {k: i for i, k in enumerate(BASE + ADDED)}
    for batch in batches:
        base_out, counts, cands = [], [], []
        for text in batch.column(1).to_pylist():
            base, cand = spans_of(text) if text else ([], [])
            base.sort(key=lambda x: (kinds[x[0]], x[1]))
            n = Counter(k for k, _, _ in base)
            base_out.append([f"{k}:{a}:{b}" for k, a, b in base])
            counts.append([n[k] for k in BASE])
            cands.append([{"kind": k, "a": a, "b": b, "pattern": p} for k, a, b, p in cand])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base_out, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64())),
             pa.array(cands, pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("pattern", pa.string())])))],
            ["doc_id", "base", "counts", "cands"])


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns.  Returns the probability that each pattern is
    personal data, each labeler's rates of +1 / 0 / -1 in both classes, and the share of the class."""
    n_labelers = votes.shape[1]
    p = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))  # start from the majority
    rates, share = np.zeros((2, n_labelers, 3)), 0.5
    for _ in range(rounds):
        for c, w in ((1, counts * p), (0, counts * (1 - p))):
            for j in range(n_labelers):
                prior = np.array([2.0, 2.0, 1.0] if c else [1.0, 2.0, 2.0])  # +1, 0, -1: labelers beat chance
                rates[c, j] = [w[votes[:, j] == v].sum() for v in (1, 0, -1)] + prior
                rates[c, j] /= rates[c, j].sum()
        share = (1 + (counts * p).sum()) / (2 + counts.sum())
        odds = np.full(len(votes), np.log(share / (1 - share)))
        for j in range(n_labelers):
            v = 1 - votes[:, j]
            odds += np.log(rates[1, j, v]) - np.log(rates[0, j, v])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, rates, float(share)


def fit_classifier(x: np.ndarray, p: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps, weighted by pattern counts."""
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        grad = x.T @ (counts * (p - q)) - ridge * weights
        hess = (x * (counts * q * (1 - q))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return weights


def features(patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Votes, and the classifier's inputs: kind, votes for and against, length class, looks of the span."""
    parts = [p.split("|") for p in patterns]
    votes = np.array([[int(v) for v in x[1].split(",")] for x in parts]).reshape(len(parts), len(LABELERS))
    kinds = BASE + ADDED
    looks = 1 + len(kinds) + 2 * len(LABELERS) + 4
    x = np.zeros((len(parts), looks + 16))
    x[:, 0] = 1
    for i, part in enumerate(parts):
        x[i, 1 + kinds.index(part[0])] = 1
        x[i, 1 + len(kinds) + 2 * len(LABELERS) + int(part[2])] = 1
        for j, v in enumerate(part[3]):
            x[i, looks + 4 * j + int(v)] = 1
    x[:, 1 + len(kinds):1 + len(kinds) + len(LABELERS)] = votes > 0
    x[:, 1 + len(kinds) + len(LABELERS):1 + len(kinds) + 2 * len(LABELERS)] = votes < 0
    return votes, x


def accepted(counts_by_pattern: dict[str, int], threshold: float = 0.5) -> set[str]:
    """Patterns that the trained classifier takes for personal data."""
    if not counts_by_pattern:
        return set()
    patterns = sorted(counts_by_pattern)
    counts = np.array([counts_by_pattern[p] for p in patterns], float)
    votes, x = features(patterns)
    p, _, _ = fit_votes(votes, counts)
    scores = 1 / (1 + np.exp(-np.clip(x @ fit_classifier(x, p, counts), -30, 30)))
    return {k for k, s in zip(patterns, scores) if s >= threshold}


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (list of kind:start:end), added (the same)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text"))
    found = cut_lineage(rows.mapInArrow(_scan, f"doc_id {id_type}, base array<string>, counts array<bigint>, "
                                               "cands array<struct<kind:string,a:bigint,b:bigint,pattern:string>>"))
    # one row per pattern: at most kinds x 3^labelers x length classes
    tally = found.select(F.explode("cands.pattern").alias("pattern")).groupBy("pattern").count().collect()
    good = accepted({r["pattern"]: r["count"] for r in tally}, threshold)
    good = sorted(p for p in good if p.split("|")[0] in ADDED)
    yes = F.array(*[F.lit(p) for p in good]).cast("array<string>")
    own = F.filter("cands", lambda c: F.array_contains(yes, c["pattern"]))
    order = F.array(*[F.lit(k) for k in ADDED])
    keyed = F.sort_array(F.transform(own, lambda c: F.struct(F.array_position(order, c["kind"]).alias("k"), c["a"].alias("a"), c["b"].alias("b"),
                                                             c["kind"].alias("kind"))))
    added = F.transform(keyed, lambda c: F.concat_ws(":", c["kind"], c["a"].cast("string"), c["b"].cast("string")))
    return found.select("doc_id", *[F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(BASE)], "base", added.alias("added"))
