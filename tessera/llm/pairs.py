"""Problem 5: defective prompt and response pairs.

A multi-label linear classifier over hashed word n-grams of both whole sides and features of the pair. It is trained on pairs made
from a bounded sample of the rows: their responses cut off, emptied, replaced by refusals, by copies of the prompt and by
responses in another language. The rows themselves serve as sound pairs. Two models fitted on the same sample supply features: one
tells a sentence's language by character n-grams, one how much a sentence declines by word n-grams. The latter starts from
sentences made by a small grammar; in a second round it also learns the sentences of those rows that the first round's
classifier took for refusals, so the collection's own wordings need not be in the grammar. Probabilities are calibrated (Platt) and
thresholds set on made pairs that the classifier wasn't trained on."""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import mix, one_per_key, words

DEFECTS = ("empty", "truncated", "refusal", "copies_question", "wrong_language")
DIMENSIONS = 1 << 18

# Frequent small words by language.
SMALL_WORDS = {
    "en": "the of and to in is was are were be been it its they them that this which what who how why when where does do did for with from by on at an as but or if not no than then before after because since until unless each only about while whereas once rest most mostly has had have will would can cannot could i you we he she his her their my your please sorry question answer",
    "fr": "le la les un une des du de et est sont était été que qui quoi où quand pourquoi comment dans par pour sur avec sans alors parce puis elle elles il ils nous vous je ne pas plus ce cette ces se son sa ses leur leurs au aux en entre avant après depuis si mais ou quel quelle fait font a ont désolé question réponse",
    "de": "der die das den dem des ein eine einer eines einem einen und ist sind war wurde wird werden nicht kein keine von zu zum zur im in mit für auf aus bei nach vor seit über zwischen wenn dann weil obwohl bevor dass daß was wer wie wann warum wo welche er sie es ich wir ihr sich auch nur noch so dort an als oder aber hat haben leider frage antwort",
    "es": "el la los las un una unos unas de del y es son era fue fueron que qué quién quien cómo cuándo cuando dónde por para porque con sin en entre sobre desde hasta entonces antes después pero o si no se su sus al lo le les hay ha han hace este esta estas yo usted más muy solo donde año pregunta respuesta",
    "it": "il lo la gli le un uno una di del della dei delle e è sono era che chi come quando perché dove con senza per da nel nella alla non più ma o se si suo sua loro questo questa anche poi dopo prima",
    "pt": "o os a as um uma uns umas de do da dos das e é são era foi que quem como quando porque onde com sem para por em no na nos nas não mais mas ou se seu sua este esta também depois antes",
    "nl": "de het een en is zijn was waren van voor met op aan in uit bij naar dat die wie wat hoe wanneer waarom waar niet geen maar of als dan omdat ook nog er ik jij wij hij zij",
}
# How a language is called, in any language.
LANGUAGE_NAMES = {
    "en": ["english", "anglais", "englisch", "englische", "englischen", "inglés", "английский", "английском", "英語"],
    "fr": ["french", "français", "française", "französisch", "französische", "französischen", "francés", "французский", "французском", "フランス語"],
    "de": ["german", "allemand", "deutsch", "deutsche", "deutschen", "alemán", "немецкий", "немецком", "ドイツ語"],
    "es": ["spanish", "espagnol", "spanisch", "spanische", "spanischen", "español", "castellano", "испанский", "испанском", "スペイン語"],
    "it": ["italian", "italien", "italienisch", "italiano", "итальянский", "イタリア語"],
    "pt": ["portuguese", "portugais", "portugiesisch", "portugués", "português", "португальский", "ポルトガル語"],
    "nl": ["dutch", "néerlandais", "niederländisch", "neerlandés", "holandés", "голландский", "オランダ語"],
    "ru": ["russian", "russe", "russisch", "russische", "russischen", "ruso", "русский", "русском", "ロシア語"],
    "ja": ["japanese", "japonais", "japanisch", "japanische", "japanischen", "japonés", "японский", "японском", "日本語"],
}
# What stands for a missing value.
PLACEHOLDERS = ["none", "null", "nil", "nan", "n/a", "na", "n.a.", "tbd", "todo", "tba", "empty", "<empty>", "(empty)", "(blank)", "(none)", "(null)", "[empty]", "[blank]", "<blank>", "<null>", "<none>", "undefined", "no answer", "no response", "not available", "missing", "unknown", "placeholder", "[]", "{}", "()", "\"\"", "''", "?", "??", "...", "…", "-", "--", "—", "xxx", "#n/a", "void", "blank", "to be done", "to do", "no data", "keine antwort", "sans réponse", "sin respuesta", "vide", "leer", "vacío", "нет ответа", "нет", "なし", "未定"]
# A grammar of declining by language; alternatives are parted by bars, {name} stands for another rule, {x} for a name in the prompt.
DECLINING = {
    "en": {
        "lead": "||Sorry,|Sorry, but|I am sorry, but|I'm sorry.|My apologies.|Unfortunately,|Regrettably,|I'm afraid|Thanks, but|Thank you.|As a model,|Sadly,",
        "say": "I cannot {do} {what}|I can't {do} {what}|I could not {do} {what}|I am unable to {do} {what}|I'm unable to {do} {what}|I am not able to {do} {what}|I'm not able to {do} {what}|I won't {do} {what}|I will not {do} {what}|I must decline to {do} {what}|I have to decline {what}|I must decline|I prefer not to {do} {what}|I would prefer not to {do} {what}|it is impossible for me to {do} {what}|I do not know {know}|I don't know {know}|I have no {lack}|I do not have {lack}|I don't have {lack}|I lack {lack}|I am missing {lack}|I can say nothing about {x}|I can't offer {lack}|nothing about {x} is known to me",
        "do": "answer|help with|help you with|assist with|respond to|reply to|comment on|discuss|talk about|explain|address|say anything about|say|tell you anything on|provide an answer to|give an answer to",
        "what": "this|that|it|your question|the question|this question|this request|such requests|{x}|that topic",
        "know": "|that|this|enough|enough about this|the answer|the answer to that|anything about {x}|how to answer",
        "lack": "any information|information about {x}|information on this|enough information|the information for this|an answer|the answer|an opinion on {x}|knowledge of {x}|access to this|the means to answer|the data|details of {x}",
        "tail": "||||now|at the moment|today|for you|here|with what I have|for lack of data|as I have no access to it",
        "close": "||||Please try again later.|Please consult a specialist.|Please look elsewhere.|You could check another place.|You may find it elsewhere.|Perhaps someone else can help.|Can I help with anything else?|Is there anything else?|I apologize.|Please rephrase it.|Another person may know.|I hope that is all right.",
    },
    "fr": {
        "lead": "||Désolé,|Désolée,|Je suis désolé, mais|Je suis navré.|Pardon, mais|Hélas,|Malheureusement,|Merci, mais|Merci.|Je m'excuse.",
        "say": "je ne peux pas {do}|je ne puis {do}|je ne saurais {do}|je ne suis pas en mesure de {do}|je ne suis pas capable de {do}|il m'est impossible de {do}|je refuse de {do}|je dois refuser|je dois refuser de {do}|je ne souhaite pas {do}|je préfère ne pas {do}|je ne sais pas|je ne sais rien de {x}|je n'ai pas {lack}|je n'ai aucune {lack2}|je ne dispose pas {lack}|je ne peux rien dire de {x}|je ne peux pas {do}",
        "do": "répondre|répondre à cela|répondre à cette question|répondre à votre demande|vous aider|vous aider avec cela|dire cela|commenter {x}|donner une réponse|fournir une réponse|expliquer cela|parler de {x}|aider",
        "lack": "de réponse|d'informations|assez d'informations|les informations pour cela|de données sur {x}|la réponse|l'accès à cela",
        "lack2": "information|information sur {x}|réponse|donnée|idée|connaissance de {x}",
        "tail": "|||maintenant|pour l'instant|ici|faute de données",
        "close": "|||Essayez plus tard.|Cherchez ailleurs, s'il vous plaît.|Veuillez consulter un spécialiste.|Quelqu'un d'autre le sait peut-être.|Puis-je vous aider autrement ?|Veuillez reformuler.|Vous pouvez vérifier ailleurs.",
    },
    "de": {
        "lead": "||Entschuldigung,|Verzeihung,|Es tut mir leid, aber|Es tut mir leid.|Tut mir leid,|Leider|Bedauere,|Danke, aber|Danke.|Bedauerlicherweise",
        "say": "ich kann {what} nicht {do}|kann ich {what} nicht {do}|ich darf {what} nicht {do}|ich möchte {what} nicht {do}|ich werde {what} nicht {do}|ich bin nicht imstande, {what} zu {do}|ich bin nicht in der Lage, {what} zu {do}|es ist mir unmöglich, {what} zu {do}|es ist mir nicht möglich, {what} zu {do}|ich weiß das nicht|ich weiß es nicht|ich weiß nichts über {x}|weiß ich das nicht|ich habe {lack}|habe ich {lack}|mir fehlen {lack2}|ich muss das ablehnen|ich lehne das ab|ich kann dazu nichts sagen|kann ich dazu nichts sagen|zu {x} kann ich nichts sagen|ich kann damit nicht helfen|dabei kann ich nicht helfen",
        "what": "das|dies|es|die Frage|diese Frage|Ihre Frage|Ihre Anfrage|diese Anfrage|darauf",
        "do": "beantworten|erklären|sagen|kommentieren|antworten|lösen|bearbeiten",
        "lack": "keine Antwort|keine Antwort darauf|keine Informationen|keine Informationen dazu|keine Angaben über {x}|nicht genug Informationen|keine Kenntnis von {x}|keinen Zugang dazu",
        "lack2": "die Daten|die Informationen|Kenntnisse über {x}|Einzelheiten dazu",
        "tail": "|||jetzt|im Moment|hier|ohne weitere Daten",
        "close": "|||Versuchen Sie es später.|Bitte suchen Sie anderswo.|Fragen Sie bitte einen Fachmann.|Vielleicht weiß es jemand anders.|Kann ich sonst helfen?|Bitte formulieren Sie um.|Sie können anderswo nachsehen.",
    },
    "es": {
        "lead": "||Lo siento,|Lo siento, pero|Lo siento.|Perdone,|Disculpe, pero|Lamentablemente,|Por desgracia,|Gracias, pero|Gracias.|Me disculpo.",
        "say": "no puedo {do}|no podría {do}|no soy capaz de {do}|no estoy en condiciones de {do}|me es imposible {do}|no me es posible {do}|no quiero {do}|prefiero no {do}|me niego a {do}|debo rechazar esto|debo negarme a {do}|no sé|no lo sé|no sé nada de {x}|no tengo {lack}|carezco de {lack2}|no dispongo de {lack2}|no puedo decir nada de {x}|nada puedo decir sobre {x}",
        "do": "responder|responder a eso|responder a esta pregunta|contestar|contestar a su pregunta|ayudar|ayudarle|ayudarle con eso|decir eso|comentar {x}|dar una respuesta|explicar eso|hablar de {x}",
        "lack": "respuesta|información|información sobre {x}|datos|datos suficientes|idea|acceso a eso|la respuesta",
        "lack2": "información|datos sobre {x}|información suficiente|conocimientos de {x}|medios para eso",
        "tail": "|||ahora|por ahora|aquí|por falta de datos",
        "close": "|||Inténtelo más tarde.|Busque en otro lugar, por favor.|Consulte a un especialista.|Quizás otra persona lo sepa.|¿Puedo ayudar en algo más?|Por favor, formule de otro modo.|Puede mirar en otra parte.",
    },
    "ru": {"lead": "||К сожалению,|Извините,|Простите, но", "say": "я не могу {do}|я не в состоянии {do}|я не знаю|у меня нет {lack}|мне нечего сказать", "do": "ответить|помочь|ответить на это|сказать это|обсуждать {x}", "lack": "ответа|сведений|данных о {x}|информации", "tail": "||сейчас", "close": "||Попробуйте позже.|Обратитесь к специалисту."},
    "ja": {"lead": "||申し訳ありませんが、|すみません、|残念ながら、", "say": "{what}お答えできません|{what}答えられません|{what}わかりません|{what}回答を控えます|{what}情報がありません|お手伝いできません", "what": "|それには|この質問には|その件は|{x}については", "tail": "|", "close": "||他をお調べください。|また後でお試しください。"},
}
# What a decorated copy may begin with, and marks put around it.
LEADS = ["Question: ", "Q: ", "> ", "Answer: ", "A: ", "Re: ", "- ", "# "]
WRAPS = [("", ""), ("", ""), ("", ""), ("\"", "\""), ("'", "'"), ("“", "”"), ("«", "»"), ("*", "*"), ("**", "**"), ("(", ")"), ("`", "`")]
# Yes and no.
YES_NO = ["yes", "no", "Yes.", "No.", "oui", "non", "Oui.", "Non.", "ja", "nein", "Ja.", "Nein.", "sí", "no", "Sí.", "да", "нет", "はい", "いいえ"]
# Scripts that tell a language, as ranges of code points.
SCRIPTS = [("ru", 0x400, 0x52F), ("ja", 0x3040, 0x30FF), ("el", 0x370, 0x3FF), ("he", 0x590, 0x5FF), ("ar", 0x600, 0x6FF), ("hi", 0x900, 0x97F), ("th", 0xE00, 0xE7F), ("ko", 0xAC00, 0xD7AF), ("zh", 0x4E00, 0x9FFF)]

_VOTES: dict[str, list[str]] = {}
for _lang, _ws in SMALL_WORDS.items():
    for _w in _ws.split():
        _VOTES.setdefault(_w, []).append(_lang)
_NAMED = {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names}
_CJK_NAMES = [(name, lang) for name, lang in _NAMED.items() if name.endswith("語")]
_PLACEHOLDERS = frozenset(PLACEHOLDERS)
_ITEM = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s+\S")
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？\n]*")
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_INVISIBLE = re.compile(r"[\s\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]+")
_ALNUM = re.compile(r"[^\W_]")
_OTHER_SCRIPT = re.compile(r"[^\W\d_\u0000-\u036f]+")
_STOPS = tuple(".!?。！？")


# languages -----------------------------------------------------------------------------------------------------------


def script_of(text: str) -> str:
    """The language that at least half the letters' script tells, or ''. Ideographs with any kana are Japanese."""
    if text.isascii() or not (odd := _OTHER_SCRIPT.findall(text)):
        return ""
    seen: Counter = Counter()
    for run in odd:
        for c in run:
            seen[next((lang for lang, a, b in SCRIPTS if a <= ord(c) <= b), "")] += 1
    if seen["ja"]:
        seen["ja"] += seen.pop("zh", 0)
    lang, n = max(seen.items(), key=lambda x: (x[1], x[0]))
    return lang if lang and 2 * n >= sum(map(str.isalpha, text)) else ""


def _small_words(ws: list[str]) -> Counter:
    votes: Counter = Counter()
    for w in ws:
        for lang in (langs := _VOTES.get(w, ())):
            votes[lang] += 1 / len(langs)
    return votes


@dataclass
class Languages:
    """Naive Bayes over character n-grams (one to three) of words. Fitted on sentences whose small words leave no doubt; votes of
    small words count on top, and alone where nothing was fitted."""

    names: list[str] = field(default_factory=list)
    grams: dict[str, list[float]] = field(default_factory=dict)
    known: dict = field(default_factory=dict)

    @staticmethod
    def _grams(word: str):
        w = f" {word} "
        return [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    @classmethod
    def fit(cls, texts: list[str], least_words: int = 200) -> Languages:
        counts: dict[str, Counter] = {}
        n: Counter = Counter()
        for text in texts:
            for s in _SENTENCE.findall(text):
                votes = _small_words(ws := words(s)).most_common(2)
                if script_of(s) or not votes or votes[0][1] < 2 or (len(votes) > 1 and votes[1][1] > votes[0][1] / 2):
                    continue
                lang = votes[0][0]
                n[lang] += len(ws)
                counts.setdefault(lang, Counter()).update(g for w in ws if w.isalpha() for g in cls._grams(w))
        names = sorted(lang for lang in counts if n[lang] >= least_words)
        every = {g for lang in names for g, k in counts[lang].items() if k > 1}
        size = {lang: sum(counts[lang].values()) + 0.5 * len(every) for lang in names}
        logs = {}
        for g in every:
            x = [np.log((counts[lang][g] + 0.5) / size[lang]) for lang in names]
            mean = sum(x) / len(x)
            logs[g] = [float(v - mean) for v in x]
        return cls(names, logs)

    def _word(self, w: str) -> tuple[np.ndarray, dict]:
        """(what a word says for each name, n-grams and votes together; its votes for other languages)."""
        if (x := self.known.get(w)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = [self.grams[g] for g in self._grams(w) if g in self.grams] if w.isalpha() else []
            # n-grams overlap: a word counts as a third of theirs
            scores, others = (np.sum(found, axis=0) / 3 if found else np.zeros(len(self.names))), {}
            for lang in (langs := _VOTES.get(w, ())):
                if lang in self.names:
                    scores[self.names.index(lang)] += 2.0 / len(langs)
                else:
                    others[lang] = 2.0 / len(langs)
            x = self.known[w] = scores, others
        return x

    def of(self, text: str) -> tuple[str, float]:
        """(language, how much speaks for it over the next one); ('', 0) if nothing tells. Languages that were not fitted count as the least
        likely of those that were, and their votes."""
        if lang := script_of(text):
            return lang, 10.0
        if not (ws := words(text)):
            return "", 0.0
        said = [self._word(w) for w in ws]
        x = np.add.reduce([v for v, _ in said]).tolist() if self.names else []
        score = dict(zip(self.names, x))
        low = min(x) if len(x) > 1 else 0.0
        for _, others in said:
            for lang, v in others.items():
                score[lang] = score.get(lang, low) + v
        if not score:
            return "", 0.0
        first, *rest = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:2]
        margin = first[1] - (rest[0][1] if rest else 0.0)
        return (first[0], margin) if margin > 0.5 else ("", 0.0)


# n-grams -------------------------------------------------------------------------------------------------------------

#: Numbers below this belong to the pair's own features, the others to n-grams, which learn more slowly.
_PAIR_PART = 1 << 13
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Grams:
    """Numbers of the distinct word n-grams (up to `most` words, with marks for both ends) of sentences or whole texts, many at a time."""

    def __init__(self, limit: int = 100_000):
        self.hashes: dict[str, int] = {}
        self.known: dict[tuple[str, int], np.ndarray] = {}
        self.limit = limit

    def __call__(self, text: str, side: int, most: int = 3) -> np.ndarray:
        if (text, side) not in self.known:
            self.learn([text], side, most)
        return self.known[text, side]

    def learn(self, texts, side: int, most: int = 3) -> None:
        """Keeps the numbers of all texts; what was kept before is dropped where it becomes too much."""
        texts = [t for t in dict.fromkeys(texts) if (t, side) not in self.known]
        if len(self.known) + len(texts) > self.limit:
            self.known.clear()
        if len(self.hashes) > 400_000:
            self.hashes.clear()
        hashes, lengths = [], []
        for t in texts:
            ws = words(t)
            lengths.append(len(ws) + 2)
            hashes.append(1)
            for w in ws:
                if (x := self.hashes.get(w)) is None:
                    x = self.hashes[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                hashes.append(x)
            hashes.append(2)
        if not texts:
            return
        h, owner = np.array(hashes, np.uint64) + np.uint64(side), np.repeat(np.arange(len(texts)), lengths)
        ends = np.cumsum(lengths)
        inner = np.ones(len(h), bool)
        inner[ends - 1] = inner[ends - np.array(lengths)] = False
        made, owners, last = [h[inner]], [owner[inner]], h
        for n in range(1, most):
            last = mix(last[:-1] * _MULTIPLY[n] + h[n:])
            within = owner[: len(last)] == owner[n:]
            made.append(last[within])
            owners.append(owner[: len(last)][within])
        ids = (mix(np.concatenate(made)) % np.uint64(DIMENSIONS - _PAIR_PART)).astype(np.int64) + _PAIR_PART
        both = np.unique(np.concatenate(owners) * DIMENSIONS + ids)
        cut = np.searchsorted(both, np.arange(len(texts) + 1) * DIMENSIONS)
        both &= DIMENSIONS - 1
        for i, t in enumerate(texts):
            # a text without words has only its marks, which say nothing
            self.known[t, side] = both[cut[i] : cut[i + 1]] if lengths[i] > 2 else both[:0]


class Declining:
    """How much a sentence declines to answer: mean log-odds of its n-grams in sentences that do, against others."""

    def __init__(self, odds: np.ndarray):
        self.odds = odds

    @classmethod
    def fit(cls, made: list[tuple[float, np.ndarray]], responses: list[list[np.ndarray]], rounds: int = 5) -> tuple[Declining, np.ndarray]:
        """(the model, whether each response has a sentence that declines), from sentences (weight, n-grams) that decline and the
        sentences of responses of unknown kind, by expectation maximization: a response one of whose sentences declines lends its
        sentences to the declining side, the others (what else it says) with half a vote."""
        base, total, most = np.zeros(DIMENSIONS), sum(w for w, _ in made), np.full(len(responses), -9.0)
        for w, ids in made:
            base[ids] += w
        flat = np.concatenate([ids for r in responses for ids in r] or [np.zeros(0, np.int64)])
        length = np.array([len(ids) for r in responses for ids in r], np.int64)
        of = np.repeat(np.arange(len(responses)), [len(r) for r in responses])
        # a response's sentences as one side or the other, by their weights
        weight, out = np.zeros(len(length)), None
        for _ in range(rounds):
            w = np.repeat(weight, length)
            yes = base + 2 * np.bincount(flat, w, DIMENSIONS)
            no = np.bincount(flat, 1.0 - np.minimum(1, 2 * w), DIMENSIONS)
            odds = np.log((yes + 0.5) / (total + 2 * weight.sum() + 1)) - np.log((no + 0.5) / (len(length) - weight.sum() + 1))
            # what was seen a few times says little, above all that it isn't a way to decline
            out = cls((np.clip(odds, -5, 5) * (yes + no) / (yes + no + 5)).astype(np.float32))
            if not len(length):
                break
            start = np.cumsum(length) - length
            score = np.where(length > 0, np.add.reduceat(np.append(out.odds[flat], 0), start) / np.maximum(length, 1), 0)
            most = np.full(len(responses), -9.0)
            np.maximum.at(most, of, score)
            weight = np.where(most[of] > 0.8, np.where(score > 0.3, 1.0, 0.5), 0.0)
        return out, most > 0.8

    def of(self, ids: np.ndarray) -> float:
        return float(self.odds[ids].mean()) if len(ids) else 0.0


# features ------------------------------------------------------------------------------------------------------------


def _bucket(x: float, steps: tuple) -> int:
    return bisect_right(steps, x)


def _end(text: str) -> str:
    t = text.rstrip()
    last = t[-1:]
    if not last:
        return "none"
    if last in ".!?。！？…":
        return "abbreviation" if re.search(r"\d[.]$", t) and not re.search(r"\d{4}[.]$", t) else "stop"
    if last in "\"'”»)]}*`」":
        return "closed-stop" if t.rstrip("\"'”»)]}*`」")[-1:] in _STOPS else "closed"
    if last in ",;:-–—(/[{&+=":
        return "hanging"
    return "digit" if last.isdigit() else "letter" if last.isalpha() else "other"


@dataclass
class Rows:
    """Sparse rows: feature numbers, their values, and where each row begins."""

    flat: np.ndarray
    values: np.ndarray
    starts: np.ndarray

    def part(self, a: int, b: int) -> Rows:
        ends = np.append(self.starts, len(self.flat))
        return Rows(self.flat[ends[a] : ends[b]], self.values[ends[a] : ends[b]], self.starts[a:b] - ends[a])


class Features:
    """Feature numbers of pairs, given the two models of the sample."""

    def __init__(self, languages: Languages | None = None):
        self.languages, self.grams = languages or Languages(), Grams()
        # sentences and prompts recur; what is kept is bounded
        self.of = lru_cache(20_000)(self.languages.of)
        self.names: dict[str, int] = {}

    def _number(self, name: str) -> int:
        if (k := self.names.get(name)) is None:
            if len(self.names) > 200_000:
                self.names.clear()
            k = self.names[name] = xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) & (_PAIR_PART - 1)
        return k

    def shares(self, text: str) -> tuple[Counter, Counter]:
        """Language -> letters of the sentences in it, and how much speaks for these."""
        out, sure = Counter(), Counter()
        for s in _SENTENCE.findall(text):
            lang, margin = self.of(s)
            if margin >= 1:
                out[lang] += len(s)
                sure[lang] += margin
        return out, sure

    def pair(self, prompt: str | None, response: str | None, declining: Declining | None) -> tuple[list[str], list[np.ndarray]]:
        """(names of the pair's own features, numbers of n-grams of both whole sides). Nulls count as empty texts."""
        p, r = prompt or "", response or ""
        t = r.strip()
        bare = _INVISIBLE.sub("", t)
        rw, pw = words(t), words(p)
        f = ["bias"]
        # empty
        solid = t.lower().strip(".!?\"'`*_<>[](){}:; ​﻿")
        nothing = not _ALNUM.search(bare)
        held = nothing or bare.lower() in _PLACEHOLDERS or t.lower() in _PLACEHOLDERS or solid in _PLACEHOLDERS
        if nothing:
            f.append("nothing")
        if held:
            f.append("placeholder")
        size = _bucket(len(rw), (1, 2, 3, 5, 8, 13, 21, 40))
        f.append(f"size={size}")
        # how it ends
        end = _end(r)
        lines = [x for x in t.split("\n") if x.strip()] or [""]
        item = bool(_ITEM.match(lines[-1]))
        sentences = len(re.findall(r"[.!?。！？](?:\s|$)", t))
        fragment = len(words(re.split(r"[.!?。！？]\s|\n", t)[-1])) if end not in ("stop", "closed-stop") else 0
        open_quote = any(t.count(a) % 2 if a == b else t.count(a) > t.count(b) for a, b in (("\"", "\""), ("“", "”"), ("«", "»"), ("(", ")"), ("[", "]"), ("{", "}")))
        fence = t.count("```")
        kind = "item" if item else "code" if fence and fence % 2 == 0 and t.endswith("```") else "text"
        f += [f"end={end}", f"end={end}&{kind}", f"end={end}&{kind}&size={size}", f"end={end}&{kind}&sentences={min(sentences, 3)}", f"fragment={min(fragment, 8)}&{kind}"]
        if open_quote and not held:
            f.append(f"open&{kind}")
        if fence % 2:
            f.append("open-fence")
        if rw and kind == "text" and end not in ("stop", "closed-stop"):
            f += [f"asked={' '.join(pw[:2])}&open-end&{min(size, 4)}", f"asked={' '.join(pw[:1])}&open-end&{min(size, 4)}", f"last={rw[-1]}&open-end"]
        if not held and re.fullmatch(r"[-*•+]\s*", lines[-1].strip() + " "):
            f.append("bare-bullet")
        # copies
        if rw and pw and not held:
            a, b = Counter(rw), Counter(pw)
            common = sum((a & b).values())
            out, back = common / len(rw), common / len(pw)
            rest = len(rw) - common
            o, k = _bucket(out, (0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1)), _bucket(back, (0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1))
            f += [f"copied={o}", f"back={k}", f"copied={o}&back={k}", f"rest={min(rest, 8)}&back={k}"]
            if len(pw) > 3 and min(out, back) >= 0.7 and len(rw) >= 3:
                f.append("mostly-copy")
            if len(pw) > 3 and back >= 0.7 and set(rw) <= set(pw):
                f.append("only-copy")
        # declining, by sentence; and n-grams of both sides
        grams = [self.grams(p, 7, 2)]
        parts = [(len(s), self.grams(s, 0)) for s in _SENTENCE.findall(t)]
        grams += [g for _, g in parts]
        if rw and not held and declining is not None:
            said = [(n, declining.of(g)) for n, g in parts if len(g)]
            total = max(1, sum(n for n, _ in said))
            score = sum(n * s for n, s in said) / total
            share = sum(n for n, s in said if s > 0.5) / total
            least, most = min(s for _, s in said), max(s for _, s in said)
            steps = (-1.5, -0.75, -0.25, 0, 0.25, 0.5, 0.75, 1, 1.5, 2)
            f += [f"declining={_bucket(share, (0.01, 0.3, 0.5, 0.7, 0.9, 1))}", f"declines={_bucket(score, steps)}", f"declines={_bucket(score, steps)}&size={size}", f"least={_bucket(least, steps)}", f"least={_bucket(least, steps)}&most={_bucket(most, (0, 0.5, 1, 1.5))}", f"most={_bucket(most, steps)}&sentences={min(len(said), 4)}"]
        if sentences >= 3 or len(rw) > 24:
            f.append("long-answer")
        # language
        if not held and bare:
            mine, strength = self.shares(_CODE.sub(" ", t))
            asked, _ = self.of(p)
            low = p.lower()
            wanted = {_NAMED[w] for w in pw if w in _NAMED} | {lang for name, lang in _CJK_NAMES if name in low}
            total = sum(mine.values())
            foreign = sum(n for lang, n in mine.items() if lang != asked and lang not in wanted)
            if total and asked:
                main = max(mine.items(), key=lambda x: (x[1], x[0]))[0]
                s = _bucket(foreign / total, (0.01, 0.25, 0.5, 0.75, 1))
                state = "same" if main == asked else "wanted" if main in wanted else "other"
                sure = _bucket(strength[main], (2, 5))
                f += [f"language={state}", f"foreign={s}", f"language={state}&foreign={s}&{sure}", f"language={state}&{sure}&size={size}"]
            else:
                f.append("language=unknown")
        return f, grams

    def __call__(self, pairs, batch: int = 2_000) -> Rows:
        """The features of pairs (prompt, response, Declining). The n-grams of a side have length one together, so that a long text's
        many words don't drown what the pair as such tells."""
        pairs = list(pairs)
        flat, values, lengths = [np.zeros(0, np.int64)], [np.zeros(0)], []
        for k in range(0, len(pairs), batch):
            part = pairs[k : k + batch]
            self.grams.learn((p or "" for p, _, _ in part), 7, 2)
            self.grams.learn((s for _, r, _ in part for s in _SENTENCE.findall((r or "").strip())), 0)
            for p, r, declining in part:
                names, grams = self.pair(p, r, declining)
                own, asked, said = np.array([self._number(x) for x in names], np.int64), grams[0], np.concatenate(grams[1:]) if len(grams) > 1 else grams[0][:0]
                flat += [own, asked, said]
                values += [np.ones(len(own)), np.full(len(asked), 1 / max(1, len(asked)) ** 0.5), np.full(len(said), 1 / max(1, len(said)) ** 0.5)]
                lengths.append(len(own) + len(asked) + len(said))
        return Rows(np.concatenate(flat), np.concatenate(values).astype(np.float32), np.cumsum(lengths, dtype=np.int64) - np.array(lengths, np.int64))


# the classifier ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """weights: one column a defect; slope, offset: Platt's; limits: least calibrated probability of each defect."""

    weights: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    limits: np.ndarray
    declining: Declining | None = None
    languages: Languages = field(default_factory=Languages)


def _logits(weights: np.ndarray, rows: Rows) -> np.ndarray:
    return np.add.reduceat(weights[rows.flat] * rows.values[:, None], rows.starts, axis=0) if len(rows.starts) else np.zeros((0, len(DEFECTS)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(rows: Rows, labels: np.ndarray, epochs: int = 12, batch: int = 512, rate: float = 0.3, shrink: float = 1e-6) -> np.ndarray:
    """Logistic regressions, one per defect, by AdaGrad over batches of pairs. Features of a single pair are left out."""
    n = np.bincount(rows.flat, minlength=DIMENSIONS)
    use = np.nonzero(n > 1)[0]
    place = np.full(DIMENSIONS, len(use), np.int64)
    place[use] = np.arange(len(use))
    w, g2 = np.zeros((len(use) + 1, labels.shape[1]), np.float32), np.full((len(use) + 1, labels.shape[1]), 1e-6, np.float32)
    # the last row of w belongs to what is left out and stays 0
    step = np.append(np.where(use < _PAIR_PART, rate, rate / 4), 0).astype(np.float32)[:, None]
    parts = []
    for k in range(0, len(labels), batch):
        part = rows.part(k, min(k + batch, len(labels)))
        touched, back = np.unique(place[part.flat], return_inverse=True)
        row = np.repeat(np.arange(len(part.starts)), np.diff(np.append(part.starts, len(part.flat))))
        parts.append((touched, back, part.values[:, None], part.starts, row, labels[k : k + batch]))
    for _ in range(epochs):
        for touched, back, values, starts, row, truth in parts:
            mine = w[touched]
            error = (_sigmoid(np.add.reduceat(mine[back] * values, starts, axis=0)) - truth) / len(truth)
            each = error[row] * values
            g = np.stack([np.bincount(back, each[:, c], len(touched)) for c in range(truth.shape[1])], 1) + shrink * mine
            g2[touched] += g * g
            w[touched] = mine - step[touched] * g / np.sqrt(g2[touched])
    weights = np.zeros((DIMENSIONS, labels.shape[1]), np.float32)
    weights[use] = w[:-1]
    return weights


def _platt(z: np.ndarray, truth: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """(slope, offset) of the probability sigmoid(slope z + offset), by Newton's method with Platt's softened targets."""
    hit, miss = truth.sum(), len(truth) - truth.sum()
    if not hit or not miss:
        return 1.0, 0.0
    target = np.where(truth, (hit + 1) / (hit + 2), 1 / (miss + 2))
    x = np.stack([z, np.ones(len(z))], 1)
    a = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(x @ a)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        change = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (a - [1.0, 0.0]))
        a = a - np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


# made pairs ----------------------------------------------------------------------------------------------------------


def _cut_off(text: str, rng: random.Random) -> str | None:
    t = text.strip()
    if len(t) < 24:
        return None
    k = rng.randrange(12, len(t) - 2)
    if rng.random() < 0.6:
        k = t.rfind(" ", 0, k + 1)
    made = t[:k].rstrip() if k > 8 else ""
    if len(words(made)) < 2 or _end(made) in ("stop", "closed-stop") or (_ITEM.match(made.split("\n")[-1]) and rng.random() < 0.9):
        return None
    return made


def _lead(prompt: str, rng: random.Random) -> str:
    """Something a copy or an answer may begin with: nothing, a mark, or a few words and a colon."""
    x = rng.random()
    if x < 0.4:
        return ""
    if x < 0.7:
        return rng.choice(LEADS)
    return " ".join(rng.choice(prompt.split() or ["x"]) for _ in range(rng.randrange(1, 5))).capitalize().strip("?.!") + rng.choice([": ", ": ", " - ", " "])


def _copied(prompt: str, rng: random.Random) -> str | None:
    t = prompt.strip()
    ws = t.split()
    if len(ws) < 3:
        return None
    way = rng.randrange(8)
    if way == 1:
        t = t.lower()
    elif way == 2:
        t = t.rstrip("?.! ")
    elif way == 3:
        ws.pop(rng.randrange(len(ws)))
        t = " ".join(ws)
    elif way == 4:
        k = rng.randrange(len(ws) - 1)
        ws[k], ws[k + 1] = ws[k + 1], ws[k]
        t = " ".join(ws)
    elif way == 5:
        t = f"{t} {t}"
    elif way == 6:
        t = t.lower().strip("?¿.! ")
    elif way == 7:
        t = t.upper()
    a, b = rng.choice(WRAPS)
    return _lead(prompt, rng) + a + t + b


def _expand(rules: dict[str, str], text: str, x: str, rng: random.Random) -> str:
    while m := re.search(r"\{(\w+)\}", text):
        made = x if m[1] == "x" else rng.choice(rules[m[1]].split("|"))
        text = text[: m.start()] + made + text[m.end() :]
    return text


def declined(prompt: str, lang: str, rng: random.Random, half: int | None = None) -> str:
    """A refusal made by the grammar of a language; of its sayings only one half if `half` is 0 or 1."""
    if lang not in DECLINING or rng.random() < 0.1:
        lang = rng.choice(list(DECLINING))
    rules = DECLINING[lang]
    names = [w.strip("?.,!¿:") for w in prompt.split()[1:] if w[:1].isupper()] or [w for w in prompt.split() if len(w) > 4] or ["…"]
    x = " ".join(names[: rng.randrange(1, 3)])
    sayings = rules["say"].split("|")
    say = _expand(rules, rng.choice(sayings if half is None else sayings[half::2]), x, rng)
    lead, tail, close = (rng.choice(rules[k].split("|")) for k in ("lead", "tail", "close"))
    if not lead or lead.endswith("."):
        say = say[:1].upper() + say[1:]
    if rng.random() < 0.3:
        say = say.replace("'", "’")
    stop = "。" if lang == "ja" else rng.choice([".", ".", ".", "!", ""]) if not close else "."
    return f"{_lead(prompt, rng) if rng.random() < 0.15 else ''}{lead} {say}{' ' * bool(tail)}{tail}{stop} {close}".strip()


def made_pairs(sound: list[tuple[str, str]], rng: random.Random, responses: list[str], features: Features) -> list[tuple[str | None, str | None, int, int]]:
    """(prompt, response, number of the defect or -1, half of the grammar it uses) from sound pairs, some of them kept with
    harmless changes; responses in other languages are taken from `responses`."""
    by_language: dict[str, list[str]] = {}
    for r in responses:
        if len((shares := features.shares(r))[0]) == 1 and max(shares[1].values()) >= 3 and (len(words(r)) >= 5 or script_of(r)):
            by_language.setdefault(next(iter(shares[0])), []).append(r)
    out: list = []

    def add(p, r, k):
        out.append((p, r, k, rng.randrange(2)))

    for p, r in sound:
        add(p, r, -1)
        mine = features.of(p)[0]
        if (t := _cut_off(r, rng)) is not None:
            add(p, t, 1)
        if rng.random() < 0.5 and (t := _cut_off(r, rng)) is not None:
            add(p, t, 1)
        if r.count("```") == 2:
            body = r[: r.rfind("```")].rstrip()
            add(p, body[: max(body.find("```") + 4, len(body) - rng.randrange(1, 20))], 1)
        if rng.random() < 0.7:
            half = rng.randrange(2)
            out.append((p, declined(p, mine, rng, half), 2, half))
        if rng.random() < 0.6 and (t := _copied(p, rng)) is not None:
            add(p, t, 3)
        if rng.random() < 0.3:
            blank = rng.choice([None, "", " ", "\n", "​", ".", "…", "?", "-", "--", "—", "***", *PLACEHOLDERS])
            add(p, blank if blank is None or rng.random() < 0.5 else rng.choice([blank.upper(), blank.capitalize(), f" {blank}\n", blank + "."]), 0)
        named = {_NAMED[w] for w in words(p) if w in _NAMED}
        others = [x for x in by_language if x != mine and x not in named]
        if mine and others:
            other = rng.choice(by_language[rng.choice(others)])
            first = r[: r.find(". ") + 2] if ". " in r else ""
            if rng.random() < 0.7 or not first:
                add(p, other, 4)
            elif len(other) > 2 * len(first):
                add(p, first + other, 4)
        # sound, though it looks like a defect
        x = rng.random()
        if x < 0.15:
            a, b = rng.choice(WRAPS)
            add(p, f"{_lead(p, rng)}{a}{p.strip()}{b} {r}", -1)
        elif x < 0.22:
            add(p, _lead(p, rng) + r, -1)
        elif x < 0.32:
            half = rng.randrange(2)
            no = declined(p, mine, rng, half)
            out.append((p, f"{no} {r}" if rng.random() < 0.7 else f"{r} {no}", -1, half))
        elif mine and others and x < 0.4:
            target = rng.choice(others)
            if target in LANGUAGE_NAMES:
                name = rng.choice(LANGUAGE_NAMES[target])
                add(rng.choice([f"{name}: {p}", f"{p} ({name})", f"{name} – {r}", f"{p} {name}?"]), rng.choice(by_language[target]), -1)
        elif x < 0.44:
            add(p, f"{r.strip()}\n```\n{rng.choice('abxyz')} = {rng.randrange(200)}\n{rng.choice('abxyz')} = {rng.randrange(200)}\n```", -1)
        elif x < 0.54:
            names = [w.strip("?.,!¿") for w in p.split()[1:] if w[:1].isupper()]
            short = rng.choice([" ".join(names[:2]), " ".join(rng.choice(sound)[1].split()[: rng.randrange(1, 3)]).strip(",;:-"), str(rng.randrange(1, 2030)), rng.choice(YES_NO), rng.choice(YES_NO), f"{rng.choice(words(r) or ['x'])} {rng.randrange(300)}", f"{rng.choice('abk')}={rng.randrange(99)}"])
            if short:
                add(p, short, -1)
        elif x < 0.6:
            add(p, "\n".join(f"{rng.choice('-*')} {' '.join(r.split()[k : k + 2]).strip('.,')}" for k in range(0, 2 * rng.randrange(2, 5), 2)), -1)
    return out


#: Features that make a row unfit as an example of a sound pair before there is a classifier.
_DOUBTFUL = {"only-copy", "mostly-copy", "placeholder", "nothing", "open-fence", "language=other", *(f"end={e}&text&size={n}" for e in ("letter", "hanging", "closed", "digit") for n in range(4, 9))}


def train(rows: list[tuple[str | None, str | None]], seed: int = 5, first_rows: int = 1200) -> Model:
    """The model of sampled rows. Without usable rows nothing is ever flagged but what has no letters. The first round, which only
    finds the sample's own refusals and doubtful rows, uses at most first_rows sound rows."""
    rng = random.Random(seed)
    languages = Languages.fit([x for row in rows for x in row if x])
    features = Features(languages)
    n = len(DEFECTS)
    weights = np.zeros((DIMENSIONS, n), np.float32)
    weights[features._number("bias")] -= 5.0
    weights[features._number("nothing"), 0] += 10.0
    model = Model(weights, np.ones(n), np.zeros(n), np.full(n, 0.5), None, languages)
    whole = [(p, r) for p, r in rows if p and r]
    sound = [(p, r) for p, r in whole if _DOUBTFUL.isdisjoint(features.pair(p, r, None)[0])]
    if len(sound) < 20:
        return model
    ids = lambda t: [g for x in _SENTENCE.findall(t) if len(g := features.grams(x, 0))]
    plain = [ids(r) for _, r in whole]
    spoken = Counter()
    for (_, r), parts in zip(whole, plain):
        spoken[languages.of(r)[0]] += len(parts)
    # as many sentences of each language decline as the sample has of it
    grammar: list[list] = [[], []]
    for lang in DECLINING:
        made = [[g for _ in range(400) for g in ids(declined(rng.choice(sound)[0], lang, rng, half))] for half in (0, 1)]
        for half in (0, 1):
            grammar[half] += [(max(20, spoken[lang]) / len(made[half]), g) for g in made[half]]
    # a half's refusals are judged by what the other half teaches, as wordings nobody listed will be
    halves = [Declining.fit(grammar[1 - h], plain)[0] for h in (0, 1)]
    model.declining, declines = Declining.fit(grammar[0] + grammar[1], plain)
    doubted = {x for x, d in zip(whole, declines) if d}
    sound = [x for x in sound if x not in doubted] or sound
    taken, refused_pairs = sound[:first_rows], []
    for last in (False, True):
        made = made_pairs(taken, rng, [r for _, r in whole], features)
        made += [(p, r, 2, rng.randrange(2)) for p, r in refused_pairs]
        rng.shuffle(made)
        made_rows = features((p, r, halves[h]) for p, r, _, h in made)
        labels = np.zeros((len(made), n), np.float32)
        for i, (_, _, k, _) in enumerate(made):
            if k >= 0:
                labels[i, k] = 1
        split = len(made) * 4 // 5
        model.weights = _fit(made_rows.part(0, split), labels[:split])
        z = _logits(model.weights, made_rows.part(split, len(made)))
        for k in range(n):
            truth = labels[split:, k] > 0
            model.slope[k], model.offset[k] = _platt(z[:, k], truth)
            p = _sigmoid(model.slope[k] * z[:, k] + model.offset[k])
            tried = np.linspace(0.2, 0.8, 25)
            f1 = [2 * (hit := ((p >= x) & truth).sum()) / max(1, hit + (p >= x).sum() + truth.sum() - hit) for x in tried]
            best = np.nonzero(np.array(f1) >= max(f1) - 1e-12)[0]
            model.limits[k] = tried[best[len(best) // 2]]
        if not last:
            found = defects(whole, model, features)
            refused_pairs = [x for x, (d, _) in zip(whole, found) if d == "refusal"]
            # of the doubted rows those that turn out sound without doubt are examples again
            fine = [x for x, (d, p) in zip(whole, found) if not d and (x not in doubted or p < 0.1)]
            kept = set(sound) | doubted
            taken = [x for x in fine if x in kept] or sound
    return model


def defects(rows: list, model: Model, features: Features | None = None) -> list[tuple[str | None, float]]:
    """(defect or None, its calibrated probability) for pairs; of several defects the one farthest above its threshold."""
    features = features or Features(model.languages)
    probability = _sigmoid(model.slope * _logits(model.weights, features((p, r, model.declining) for p, r in rows)) + model.offset)
    over = (probability - model.limits) / (1 - model.limits)
    best = over.argmax(1) if len(rows) else []
    return [(DEFECTS[k], float(s[k])) if o[k] >= 0 else (None, float(s.max())) for k, o, s in zip(best, over, probability)]


def defective_pairs(df: DataFrame, key: str = "example_id", prompt: str = "input", response: str = "output", sample_rows: int = 3_000) -> DataFrame:
    """key, defect, probability of every pair found defective, at most one defect each; the classifier is trained on at most
    `sample_rows` rows (those with the least hash of their key), all rows are judged. Null and blank responses are `empty`;
    null keys are dropped, repeated keys count once; an empty table gives no rows."""
    rows = one_per_key(df.select(F.col(key).alias("key"), F.col(prompt).alias("prompt"), F.col(response).alias("response")), "key")
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(sample_rows).collect()  # bounded by sample_rows
    sent = df.sparkSession.sparkContext.broadcast(train([(r["prompt"], r["response"]) for r in sample]))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        model = sent.value
        features = Features(model.languages)
        for b in batches:
            found = defects(list(zip(b.column(1).to_pylist(), b.column(2).to_pylist())), model, features)
            hit = [i for i, (d, _) in enumerate(found) if d]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit, pa.int64())), pa.array([found[i][0] for i in hit], pa.string()), pa.array([found[i][1] for i in hit], pa.float64())], ["key", "defect", "probability"])

    return rows.mapInArrow(run, f"key {kind}, defect string, probability double").select(F.col("key").alias(key), "defect", "probability")
