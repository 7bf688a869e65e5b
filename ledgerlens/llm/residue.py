"""Template residue, filler, error pages and demands for scripts in place of content.

Texts are cut into segments: lines, sentences, and windows of long runs. Weak labels come from the status
lines of responses and from phrases; the segments that they leave open take no part in the fit. A regularised
linear classifier on hashed word and shape n-grams, length and title features is fitted on a bounded sample
of documents and validated on hosts (sources) that it hasn't seen, which also gives the threshold. A
document is residue if one of its segments is; all segments of all documents are scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.linear import Rows, fit_logistic, sigmoid
from ledgerlens.runtime import Scratch

DIM = 1 << 18
#: Documents that the classifier is fitted on at most, and the share of their plain segments that is kept.
SAMPLE_DOCUMENTS, KEEP_PLAIN = 20_000, 4
#: Characters of the sample that reach the driver at most, about.
SAMPLE_CHARS = 64_000_000
#: Characters that are cut into features together, about.
CHARS = 2_000_000
#: Tasks that the sample is spread over: a limit leaves it in one.
SAMPLE_PARTS = 16
#: Probability from which an open segment counts as residue in the second fit.
SURE = 0.9
#: F1 by which a threshold may fall short of the best.
NEAR = 0.005
#: Hosts out of ten that only validate.
HELD_OUT = 3
WINDOW, STRIDE = 40, 30

# Phrases of the weak labels, in the languages of the corpus.
PLACEHOLDER = r"""\{\{\s*[^\W\d][\w .-]*\}\}|\$\{\s*[^\W\d][\w .-]*\}|<<\s*[^\W\d][\w .-]*>>|«[^\W\d][\w.-]*(?:[ _][\w.-]+){0,4}»|@@[^\W\d][\w .-]*@@|__[^\W\d_][\w .-]*__|%[^\W\d][\w]*_?[\w]*%(?!\w)|\{[^\W\d_][^\W\d]*(?:[ ._][^\W\d_]+)*\}|<(?!/?(?:noscript|script|html|body|head|title|meta|div|span|p|br|b|i|u|a|em|strong|h[1-6]|ul|ol|li|table|tr|td|th|img)\b)[^\W\d_][^\W\d]*(?:[ ._'][^\W\d_]+)*>|\[(?:insert|enter|add|your|fill in|put|type|choose|select|todo|tbd|bitte|hier|eintragen|einf[uü]gen|ins[eé]rer|[aà] compl[eé]ter|indiquer|votre|insertar|introducir|a[ñn]adir|completar|su)\b[^\]\n]{0,60}\]"""
FILLER = [
    r"\blorem\b", r"\bdolor sit\b", r"\b(?:sample|dummy|placeholder|filler|example) (?:text|words?|paragraph|content|copy)\b", r"\b(?:text|copy|content|caption|title|description|summary) (?:goes|comes) here\b",
    r"^\W*(?:description|text|details?|content|summary) (?:to follow|coming soon|pending)\W*$", r"\breplace this (?:text|paragraph|line|section)\b", r"\b(?:write|type|enter|insert) .{0,60}\bhere\W*$", r"\bleft (?:intentionally )?(?:blank|empty|without content)\b|\bintentionally left\b",
    r"\b(?:beispiel|muster|f[uü]ll|blind|platzhalter)(?:text|absatz|inhalt)\b", r"\bhier (?:steht|folgt|kommt|entsteht)\b.{0,60}$", r"\bfaux texte\b", r"\btexte? (?:[aà] remplacer|d'exemple|de ejemplo|de relleno|simulado)\b", r"\bexemple de (?:texte|paragraphe)\b", r"\baqu[ií] (?:va|ir[aá])\b.{0,60}$", r"\b(?:texto|p[aá]rrafo) de (?:ejemplo|muestra|relleno|prueba)\b",
    r"^\W*(?:heading|titel|überschrift|titre|t[ií]tulo) \d\W*$", r"\b(?:asdf|qwerty?|qwertz|azerty)\b", r"^\W*(?:x{2,}\W+)+x{2,}\W*$", r"^\W*(\w+)(?:\W+(?:\1|\d+)){2,}\W*$", r"\b(\w{3,})(?:\W+\1){3,}\b",
]
ERRORS = [
    r"\b(?:page|file|document|resource|record|url|exhibit|requested \w+)\b.{0,20}\b(?:not found|cannot be (?:found|displayed|loaded)|could not be (?:found|located|displayed|loaded))\b", r"^\W*not found\W*$", r"\bbad gateway\b", r"\binternal server error\b", r"\bservice (?:is )?(?:temporarily )?unavailable\b", r"\baccess (?:is )?denied\b", r"^\W*forbidden\b", r"\bgateway time-?out\b", r"\btoo many requests\b", r"\bsession (?:has |is )?expired\b", r"\bunauthori[sz]ed\b", r"\bsomething went wrong\b", r"\btry again later\b", r"\b(?:down|closed|offline) for (?:scheduled )?maintenance\b", r"\bdid not respond in time\b", r"\bsign in again\b", r"\bdo not have permission\b", r"\bdoes not exist on this server\b",
    r"\bzugriff verweigert\b", r"\b(?:interner )?serverfehler\b", r"\bnicht (?:gefunden|erreichbar|verf[uü]gbar)\W*$", r"\bsitzung (?:ist )?abgelaufen\b", r"\bversuchen sie es (?:sp[aä]ter|erneut)\b", r"\bmelden sie sich (?:erneut|wieder|an)\b", r"\bacc[eè]s refus[eé]\b", r"\bpage (?:introuvable|non trouv[eé]e)\b", r"\b(?:momentan[eé]ment|temporairement) indisponible\b", r"\bn'existe pas\W*$", r"\bsession expir[eé]e\b", r"\berreur (?:interne|du serveur)\b", r"\br[eé]essayez\b", r"\breconnecter\b", r"\bacceso denegado\b", r"\bno (?:encontrad[ao]|existe|est[aá] disponible)\b", r"\bsesi[oó]n (?:ha )?(?:caducad[ao]|expirad[ao]|caducado)\b", r"\berror interno\b", r"\biniciar sesi[oó]n\b", r"\bint[eé]ntelo (?:de nuevo|m[aá]s tarde)\b",
    r"^\W*traceback \(most recent call last\)", r"^\W*(?:\w+\.)*\w*(?:Error|Exception):", r"^\W*exception in thread\b", r"^\s*File \"[^\"]+\", line \d+", r"^\s*at [\w.$]+\([\w.]+:\d+\)",
]
STATUS = r"^\W*(?:HTTP/\d(?:\.\d)?\s+[1-5]\d\d\b|(?:(?:error|fehler|erreur|status|code|http)\W{0,3})+[45]\d\d\b|[45]\d\d\s+(?!.*\b(?:units?|minutes?|seconds?|metres?)\b)[^\W\d_]+(?:\s+[^\W\d_]+){0,3}\W*$)"
SCRIPTS = [
    r"\b(?:enable|activate|allow|turn on|switch on|requires?|needs?)\b.{0,30}\b(?:java ?scripts?|scripts?|scripting|cookies)\b", r"\bbrowser does not support\b", r"\b(?:java ?script|scripting) (?:is |must be |has to be )(?:required|disabled|switched off|turned off|enabled)\b", r"\bchecking your browser\b", r"<noscript>",
    r"\b(?:aktivieren|erlauben|einschalten|zulassen)\b.{0,40}\b(?:java ?script|skripte?|cookies)\b|\b(?:java ?script|skripte?|cookies)\b.{0,30}\b(?:aktivier\w*|erlaub\w*|zulassen|zugelassen|ben[oö]tigt|erforderlich)\b", r"\b(?:activer|activez|autoriser|autorisez)\b.{0,30}\b(?:java ?script|scripts?|cookies)\b|\bbesoin d\w*.{0,12}\b(?:java ?script|scripts)\b", r"\b(?:active|activar|habilite|permita)\b.{0,20}\b(?:java ?script|scripts|cookies)\b|\b(?:necesita|requiere)\b.{0,20}\b(?:java ?script|scripts|cookies)\b",
]
# Marks that editors and transcribers set, which are content.
EDITORIAL = r"""[<\[{(«](?:pause|silence|inaudible|unintelligible|unclear|crosstalk|laughter|laughs|sigh|cough|noise|sic|translated|translation|redacted|name redacted|blacked out|omitted|illegible|emphasis added|unverst[aä]ndlich|geschwärzt|pausa|inaudible|ilegible|tachado|rires|risas|lachen|\.\.\.|…)[>\]})»]"""
#: What reports or quotes rather than stands in place of content: quoted words, or a verb of reporting with a subject.
REPORTS = r"""["“”„«][^"“”„»]{2,60}["“”»]|\b(?:noted|noticed|recorded|stated|reported|displayed|showed|shows|appears?|appeared|confirmed|explained|photographed|mentioned|caused|(?<!not )found|written|wrote|read|said|says|saw|opened|seized|suspect|logged|vermerkte|zeigte|zeigt|meldete|war|habe|bestätigte|erklärte|sichergestellt\w*|noté|affichait|affiche|constaté|indiqué|confirmé|saisi|anotó|mostraba|muestra|confirmó|indicó|incautado|señaló)\b"""

_PLACEHOLDER = re.compile(PLACEHOLDER, re.I)
_FILLER = re.compile("|".join(f"(?:{p})" if "\\1" not in p else f"(?:{p})".replace(r"(\w+)", f"(?P<a>\\w+)").replace(r"(\w{3,})", f"(?P<b>\\w{{3,}})").replace("\\1", "(?P=a)" if r"(\w+)" in p else "(?P=b)") for p in FILLER), re.I)
_ERRORS = re.compile("|".join(f"(?:{p})" for p in ERRORS), re.I)
_STATUS = re.compile(STATUS, re.I)
_SCRIPTS = re.compile("|".join(f"(?:{p})" for p in SCRIPTS), re.I)
_REPORTS = re.compile(REPORTS, re.I)
_EDITORIAL = re.compile(EDITORIAL, re.I)
_SENTENCE = re.compile(r"\n+|(?<=[.!?…])[\"'”»)\]]*\s+(?=\S)")
_WORD = re.compile(r"[^\W\d_]+|\d+|\{\{|\}\}|\$\{|<<|>>|@@|_+|[^\w\s]")


def segments(text: str) -> list[str]:
    """Lines, sentences of lines, and overlapping windows of those that are long."""
    out = []
    for s in _SENTENCE.split(text):
        if s and (s := s.strip()):
            words = s.split() if len(s) > WINDOW * 5 else []
            if len(words) > WINDOW:
                out += [" ".join(words[i : i + WINDOW]) for i in range(0, len(words) - STRIDE + 1, STRIDE)] or [s]
                if (len(words) - WINDOW) % STRIDE:
                    out.append(" ".join(words[-WINDOW:]))
            else:
                out.append(s)
    return out


def weak_label(s: str) -> int:
    """1: residue by status line or phrase; 0: plain; -1: a report or quotation of an error; 2: left open."""
    s = _EDITORIAL.sub(" ", s)
    if _PLACEHOLDER.search(s):
        return 1
    hit = _STATUS.search(s) or _ERRORS.search(s) or _SCRIPTS.search(s) or _FILLER.search(s)
    if not hit:
        return 0
    if _REPORTS.search(s) and not s.lstrip().startswith(("<noscript", "File ")):
        return -1 if len(s.split()) >= 7 else 2
    return 1 if len(s.split()) <= 25 or _FILLER.search(s) else 2


_seen: dict[str, tuple[int, int]] = {}


def _token(w: str) -> tuple[int, int]:
    """Hashes of a word and of its shape."""
    got = _seen.get(w)
    if got is None:
        if w.isdigit():
            shape, word = ("S" if len(w) == 3 and w[0] in "45" else f"N{min(len(w), 5)}"), "9" * min(len(w), 5)
            word = w if shape == "S" else word
        elif w[0].isalpha():
            shape, word = ("U" if w.isupper() and len(w) > 1 else "T" if w[0].isupper() else "w"), w.lower()
        else:
            shape = word = w[:2]
        got = zlib.crc32(word.encode()), zlib.crc32(b"\0" + shape.encode())
        if len(_seen) < 500_000:
            _seen[w] = got
    return got


def featurize(segs: list[str], is_title: np.ndarray, doc_size: np.ndarray) -> Rows:
    """Hashed n-grams of words (1 to 3) and of shapes (2 to 4), with length and title features."""
    tokens, sizes = [], np.empty(len(segs), np.int64)
    for i, s in enumerate(segs):
        found = _WORD.findall(s)
        sizes[i] = len(found)
        tokens += found
    pairs = np.array([_token(w) for w in tokens], np.uint64).reshape(-1, 2)
    row = np.repeat(np.arange(len(segs)), sizes)
    index, owner = [], []
    for column, least, most in ((0, 1, 3), (1, 2, 4)):
        h = pairs[:, column]
        gram = h.copy()
        for n in range(1, most + 1):
            if n > 1:
                gram = gram[:-1] * np.uint64(1_000_003) + h[n - 1 :]
                if not len(gram):
                    break
            same = row[: len(row) - n + 1] == row[n - 1 :]
            if n >= least:
                mixed = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)
                index.append(mixed[same].astype(np.int32))
                owner.append(row[: len(row) - n + 1][same])
    index, owner = np.concatenate(index), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    start = np.searchsorted(owner[order], np.arange(len(segs)))
    chars = np.array([len(s) for s in segs], float)
    upper = np.array([sum(c.isupper() for c in s) for s in segs], float) / np.maximum(chars, 1)
    ends = np.array([s[-1] in ".!?…" for s in segs], float)
    distinct = np.array([len(set(s.lower().split())) / max(len(s.split()), 1) for s in segs])
    dense = np.stack([np.log1p(chars) / 5, upper, ends, is_title.astype(float), np.log1p(doc_size) / 3, distinct], axis=1)
    return Rows(index[order], start, dense)


@dataclass
class ResidueModel:
    """Weights, threshold, and what validation on unseen hosts gave."""

    w: np.ndarray
    wd: np.ndarray
    b: float
    threshold: float = 0.5
    validation: dict = field(default_factory=dict)

    def score(self, segs: list[str], is_title: np.ndarray, doc_size: np.ndarray) -> np.ndarray:
        return sigmoid(featurize(segs, is_title, doc_size).dot(self.w, self.wd, self.b)) if segs else np.zeros(0)


def _flat(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All segments, the text of each, whether it is the first, and how many its text has."""
    segs, owner, title, size = [], [], [], []
    for i, t in enumerate(texts):
        own = segments(t) if t else []
        segs += own
        owner += [i] * len(own)
        title += [k == 0 for k in range(len(own))]
        size += [len(own)] * len(own)
    return segs, np.array(owner, np.int64), np.array(title, bool), np.array(size, float)


def _by_size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about CHARS characters, so that long texts don't multiply in memory."""
    for batch in batches:
        size = batch["text"].str.len().fillna(0).to_numpy(float)
        part = (np.cumsum(size) // CHARS).astype(int)
        for k in np.unique(part):
            yield batch[part == k].reset_index(drop=True)


def labelled_segments(df: DataFrame, text_col: str, host_col: str | None, sample_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Segments (segment, label, title, size, held_out), labelled 1 or 0 or left open as 2, of at most ``sample_documents`` documents, chosen by hash."""
    total = max(df.count(), 1)
    # A little less than the bound, so that the limit cuts nothing and a rerun takes the same rows.
    share = 1.0 if total <= sample_documents else 0.97 * sample_documents / total
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")) if host_col else F.lit("")
    rows = df.select(F.col(text_col).alias("text"), (F.pmod(F.xxhash64(host), F.lit(10)) < HELD_OUT).alias("held_out")).filter("text is not null")
    picked = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample_documents).repartition(SAMPLE_PARTS)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _by_size(batches):
            segs, owner, title, size = _flat(list(batch["text"]))
            labels = np.array([weak_label(s) for s in segs], np.int64)
            touched = np.zeros(len(batch), bool)
            touched[owner[(labels == 1) | (labels == 2)]] = True
            # By place too, so that of a segment that recurs a share is kept and not all or none.
            seeds = [zlib.crc32((t or "").encode()) for t in batch["text"]]
            keep = np.array([(zlib.crc32(s.encode(), seeds[o]) + k) % KEEP_PLAIN == 0 for k, (s, o) in enumerate(zip(segs, owner))], bool)
            # What stands beside residue without a label of its own may be residue too: it is left open (2).
            use = (labels != 0) | keep | touched[owner]
            labels = np.where(labels == 1, 1, np.where((labels == 2) | ((labels == 0) & touched[owner]), 2, 0))
            yield pd.DataFrame({"segment": np.array(segs, object)[use], "label": labels[use].astype("int32"), "title": title[use], "size": size[use], "held_out": batch["held_out"].to_numpy()[owner[use]]})

    return picked.mapInPandas(label, "segment string, label int, title boolean, size double, held_out boolean")


def fit_residue(df: DataFrame, text_col: str = "text", host_col: str | None = "source", sample_documents: int = SAMPLE_DOCUMENTS, sample_chars: int = SAMPLE_CHARS) -> ResidueModel:
    """Fit on the sample's seen hosts, choose the threshold on its unseen hosts, and refit on both."""
    labelled = Scratch(df.sparkSession).cut(labelled_segments(df, text_col, host_col, sample_documents), "labelled")
    # Documents bound the sample's rows, characters its bytes: of longer ones a share of the segments is taken, by hash.
    chars = labelled.agg(F.sum(F.length("segment"))).first()[0] or 0
    if chars > sample_chars:
        labelled = labelled.filter(F.pmod(F.xxhash64("segment", "title", "size"), F.lit(1_000_000)) < int(sample_chars / chars * 1_000_000))
    got = labelled.toPandas().sort_values(["segment", "title", "size"], ignore_index=True)
    if not len(got) or not (got["label"] == 1).any():
        return ResidueModel(np.zeros(DIM), np.zeros(6), -35.0)

    def rows(part: pd.DataFrame) -> Rows:
        return featurize(list(part["segment"]), part["title"].to_numpy(), part["size"].to_numpy())

    def fit(part: pd.DataFrame, model: ResidueModel | None = None) -> ResidueModel:
        """Fitted twice: of the open segments, those that the first fit finds to be residue join the second. Each fit starts from the one before."""
        for sure in (None, SURE):
            if sure is not None:
                open_p = sigmoid(rows(part).dot(model.w, model.wd, model.b))
                part = part.assign(label=np.where((part["label"] == 2) & (open_p >= sure), 1, part["label"]))
            known = part[part["label"] != 2]
            y = known["label"].to_numpy(float)
            # A kept plain segment stands for those that were left out.
            near = None if model is None else (model.w, model.wd, model.b)
            model = ResidueModel(*fit_logistic(rows(known), y, np.where(y > 0, 1.0, KEEP_PLAIN), DIM, start=near))
        return model

    held = got["held_out"].to_numpy(bool)
    threshold, validation, model = 0.5, {}, None
    unseen = got[held & (got["label"] != 2)]
    y = unseen["label"].to_numpy(float)
    if y.any() and (got["label"][~held] == 1).any():
        model = fit(got[~held])
        p = sigmoid(rows(unseen).dot(model.w, model.wd, model.b))
        stands, best = np.where(y > 0, 1.0, KEEP_PLAIN), []
        for t in np.arange(0.1, 0.95, 0.05):
            hit = p >= t
            tp = float((hit & (y > 0)).sum())
            precision, recall = tp / max((stands * hit).sum(), 1), tp / y.sum()
            best.append((2 * precision * recall / max(precision + recall, 1e-9), -abs(t - 0.5), t, precision, recall))
        # Of thresholds that are nearly as good as the best, the one nearest to one half.
        top = max(best)[0]
        f1, _, threshold, precision, recall = max((b for b in best if b[0] >= top - NEAR), key=lambda b: (b[1], b[2]))
        validation = {"f1": float(f1), "precision": float(precision), "recall": float(recall), "segments": len(unseen), "residue": int(y.sum())}
    model = fit(got, model)
    model.threshold, model.validation = float(threshold), validation
    return model


def score_residue(df: DataFrame, model: ResidueModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, residue_score, is_residue, evidence): the strongest segment of each distinct non-null id.

    Null, empty and blank texts score 0 with no evidence. A repeated id takes its highest score.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _by_size(batches):
            segs, owner, title, size = _flat(list(batch["text"]))
            p = shared.value.score(segs, title, size)
            best, at = np.zeros(len(batch)), np.full(len(batch), -1)
            order = np.argsort(p, kind="stable")
            best[owner[order]], at[owner[order]] = p[order], order
            yield pd.DataFrame({"id": batch["id"], "score": best, "evidence": [segs[k] if k >= 0 else None for k in at]})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInPandas(score, f"id {kind}, score double, evidence string")
    best = scored.groupBy("id").agg(F.max(F.struct("score", "evidence")).alias("s"))
    return best.select(F.col("id").alias(id_col), F.col("s.score").alias("residue_score"), (F.col("s.score") >= model.threshold).alias("is_residue"), F.col("s.evidence").alias("evidence"))


def find_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", sample_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Fit on a bounded sample of ``df`` and score all of it; see score_residue(). An empty input gives an empty result."""
    return score_residue(df, fit_residue(df, text_col, host_col, sample_documents), id_col, text_col)


def exclude_residue(df: DataFrame, scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id isn't residue; rows without an id stay."""
    return df.join(scored.filter("is_residue").select(id_col), id_col, "left_anti")
