"""Abusive, hateful or sexual content: restored by a noisy-channel decoder, then scored.

Words that look disguised (digits or signs for letters, look-alike letters, spacing, repetition, masked letters) become
lattices of what each character may stand for. A Viterbi search finds the cheapest reading under two character language
models: one over the words that abuse needs, a prefix tree whose branch counts are its probabilities, and one over all
documents' characters. Insults are looked for first, then all words of the rules. The reading is taken if the first model explains the characters better than the second.
Restored sentences are scored twice. Rules say what is said to whom: insults, threats and wishes of harm against people,
contempt for a group, sexual wording. And phrases learnt from labelled documents: runs of up to four words that at least
``least`` labelled documents hold and of which at least ``purity`` of the holders are abusive; a sentence that consists of
them to a half, and holds a word that is abusive more often than not, is abusive whatever else it says. At most ``most_labels`` labelled documents, the first by hash, are read.

Defined results
* null, empty and blank texts score 0; every document gets one row, a repeated doc_id one;
* a text is abusive from a score of 0.5 on, which one sentence can reach; harsh words about code or oneself, technical
  terms and neutral mentions stay below;
* without any letters in the corpus the background model is uniform, without labels there are no learnt phrases;
* verdicts on one document count by their majority, a tie or null verdicts not at all.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import ship

from .leakage import ALIKE

# --- what abuse needs -------------------------------------------------------------------------------------------------
#: Nouns that are an insult whoever they are said of.
INSULTS = """idiot moron imbecile cretin halfwit asshole arsehole bastard scumbag dumbass jackass loser dickhead dipshit
shithead douchebag motherfucker cocksucker wanker twat cunt bitch prick tosser retard numbskull nitwit dimwit scum
bellend shitbag fuckwit fuckface halfwits imbeciles""".split()
#: Adjectives that go with them.
SCORN = """useless worthless pathetic clueless spineless gutless filthy miserable braindead disgusting brainless stupid
dumb ugly lazy incompetent vile rotten hopeless""".split()
#: Sexual wording that no code needs.
SEXUAL = """fuckable tits titties pussy cock cocks dick slut sluts whore whores nudes horny porn porno cum cumming blowjob
handjob boobs orgasm milf dildo hentai gangbang threesome housewives busty clit""".split()
#: Words of those lists that mean something else as well: they need company.
DOUBLE = """bastard bastards prick pricks jackass twat twats tit tits cock cocks dick cum pussy hentai milf clit""".split()
#: What nobody is called in earnest praise; an insult when said of the reader.
NAMES = """buffoon fool clown dunce dolt oaf simpleton nobody failure disgrace embarrassment parasite leech worm cockroach donkey creep pervert
freak coward liar fraud joke waste vermin cancer degenerate lowlife nuisance rat snake monkey cow dog idiot""".split()
#: What belongs to a person and not to a program.
BELONGINGS = "house|home|car|family|kids|children|child|wife|husband|mother|father|sister|brother|face|legs?|arms?|bones?|neck|throat|fingers?|teeth|skull|head|dog|cat|hands?|nose|ribs?|eyes?"
SWEAR = "fuck fucking fucked fucker shit bullshit damn ass crap goddamn".split()
#: Words of other languages.
OTHER = """arschloch scheiße scheisse fresse verpiss verreckst verrecke mistvieh mistkerl hurensohn wichser schlampe
fotze drecksau dreckskerl missgeburt vollidiot schwein trottel puta mierda cabrón cabron gilipollas pendejo imbécil carajo
hijoputa cállate callate inútil zorra maricón enculé connard salaud foutre gueule abruti merde salope pute bordel crétin
conne pauvre maldito pedazo idiota estúpido dreckiges wertloses blödes""".split()
#: words of the prefix tree that are common by themselves; they are restored so that rules can read them
PLAIN = """naked garbage rubbish people women disabled foreigners vermin parasites disease plague subhuman hammer coffin
funeral ashamed ditch keyboard strip spank lick suck spread legs moaned licked oxygen shut
listen yourself everyone nobody mother""".split()

_JOIN = " "


def plain_letters(text: str) -> str:
    """Compatibility forms, wrongly decoded UTF-8, look-alike and invisible letters undone, in lower case; layout stays."""
    if text.isascii():
        return text.lower()
    if "Ã" in text or "â€" in text or "ã€" in text or "å" in text:
        try:
            back = text.encode("cp1252").decode("utf-8")
            text = back
        except UnicodeError:
            text = re.sub("[ÂÃâ][\x80-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{1,2}", _unmojibake, text)
    out = []
    for w in re.split(r"(\s+)", unicodedata.normalize("NFKC", text)):
        if not w.isascii():
            w = "".join(c for c in w if unicodedata.category(c) not in ("Cf", "Mn") or c in "゙゚")
            if re.search(r"[a-zA-Z]", w) and re.search(r"[Ͱ-ϿЀ-ӿ]", w):
                w = w.lower().translate(ALIKE)
            elif re.fullmatch(r"[^\w]*[Ͱ-ϿЀ-ӿ]+[^\w]*", w) and (t := w.lower().translate(ALIKE)).isascii():
                w = t
        out.append(w.lower())
    return "".join(out)


def _unmojibake(m: re.Match[str]) -> str:
    try:
        return m.group().encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m.group()


# --- the decoder ------------------------------------------------------------------------------------------------------
#: What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "%": "x", "#": "h", "*": "?", "_": "?", "•": "?", "·": "?"}
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßáéíóúñçàèêôûîœ"
_AT = {c: i + 1 for i, c in enumerate(LETTERS)}
STATES = len(LETTERS) + 1


class CharModel:
    """Trigrams of characters over all documents; index 0 is the end of a word."""

    def __init__(self, counts: np.ndarray | None = None) -> None:
        c = (counts if counts is not None else np.zeros(STATES**3)).reshape(STATES, STATES, STATES).astype(float)
        pair = c.sum(axis=0)
        one = pair.sum(axis=0)
        p1 = (one + 1) / (one.sum() + STATES)
        p2 = (pair + 8 * p1) / (pair.sum(axis=1, keepdims=True) + 8)
        p3 = (c + 8 * p2) / (c.sum(axis=2, keepdims=True) + 8)
        self.cost = -np.log(p3)

    def step(self, a: int, b: int, c: int) -> float:
        return float(self.cost[a, b, c])


class Tree:
    """The words of abuse as a prefix tree: a character's probability is its branch's share of the words below."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count = [0]
        self.word: list[str | None] = [None]
        for w in words:
            at = 0
            self.count[0] += 1
            for c in w:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(0)
                    self.word.append(None)
                at = self.next[at][c]
                self.count[at] += 1
            self.word[at] = w


class Decoder:
    """Viterbi over a disguised word's lattice."""

    def __init__(self, background: CharModel, prior: float = 6.0, rule_prior: float = 1.0) -> None:
        base = INSULTS + SCORN + SEXUAL + SWEAR + OTHER + PLAIN
        many = {w + e for w in INSULTS for e in ("s", "es")}
        self.tree = Tree(sorted(set(base) | many))
        self.words = set(self.tree.word) - {None}
        # the rules' other words are common ones: to restore them says nothing by itself, so they need less evidence
        self.rule_tree = Tree(sorted(_rule_words() | self.words))
        self.all_words = set(self.rule_tree.word) - {None}
        self.longest = max(map(len, self.all_words))
        self.rule_prior = rule_prior
        self.background = background
        self.prior = prior
        self.known: dict[str, str | None] = {}

    def lattice(self, token: str) -> list[tuple[str, float, bool]]:
        """(letters it may stand for, cost, may be skipped) for each character or run of the token."""
        out: list[tuple[str, float, bool]] = []
        for i, c in enumerate(token):
            if c in _AT:
                out.append((c, 0.0, False))
            elif c in SIGNS:
                s = SIGNS[c]
                # in a row of them each masks one letter; one alone may also be a mark between letters
                alone = c not in (token[i - 1 : i], token[i + 1 : i + 2])
                out.append((LETTERS if s == "?" else s, 1.2 if s == "?" else 0.8, s == "?" and alone))
            else:
                out.append(("", 0.4, True))
        return out

    def decode(self, token: str) -> str | None:
        """The word of abuse the token stands for, if that explains it better than the background does."""
        if token in self.known:
            return self.known[token]
        if len(self.known) > 200_000:
            self.known.clear()
        lat = self.lattice(token)
        got = None
        slots, masks = sum(1 for s, _, _ in lat if s), sum(1 for s, _, _ in lat if s == LETTERS)
        if slots >= 3:
            got = self._decode(lat, self.tree, self.prior)
            # marks around a word (**it**) would mask any common word
            if got is None and 2 * masks <= slots:
                got = self._decode(lat, self.rule_tree, self.rule_prior)
        if len(token) <= 64:
            self.known[token] = got
        return got

    def _decode(self, lat: list[tuple[str, float, bool]], tree: Tree, prior: float) -> str | None:
        nxt, count, word = tree.next, tree.count, tree.word
        # state: (node of the tree, last letter); cost so far. A letter may repeat at a price, so runs collapse.
        now: dict[tuple[int, str], float] = {(0, ""): 0.0}
        for letters, price, skip in lat:
            then: dict[tuple[int, str], float] = {}
            for (node, last), cost in now.items():
                if skip:
                    k = (node, last)
                    if cost + price < then.get(k, math.inf):
                        then[k] = cost + price
                if last and last in letters and len(letters) < 5:
                    k = (node, last)
                    v = cost + price + 1.0
                    if v < then.get(k, math.inf):
                        then[k] = v
                here = nxt[node]
                for c in here if len(letters) > 4 else letters:
                    child = here.get(c)
                    if child is not None:
                        v = cost + price - math.log(count[child] / count[node])
                        k = (child, c)
                        if v < then.get(k, math.inf):
                            then[k] = v
            if not then:
                return None
            now = then
        best = min(((cost, word[node]) for (node, _), cost in now.items() if word[node]), default=None)
        if best is None:
            return None
        return best[1] if best[0] + prior < self._plain(lat) else None

    def _plain(self, lat: list[tuple[str, float, bool]]) -> float:
        """What the same lattice costs under the background: signs are taken as they are, at a price."""
        a = b = 0
        cost = 0.0
        for letters, _, _ in lat:
            if len(letters) == 1 and letters in _AT:
                c = _AT[letters]
                cost += self.background.step(a, b, c)
                a, b = b, c
            else:
                cost += 2.5
                a, b = b, 0
        return cost


# whole letters with signs between or for letters; single letters spaced by one sign; runs
_SPACED = re.compile(r"(?<![\w.])(?:[^\W_](?:[ .\-_*~|·]|\. )){3,}[^\W_](?![\w])")
_LETTER, _SIGN = "a-zß-öø-ɏ", "0-9@$!|+€£*#•%("
#: a word with a sign in it; possessive, so a long run is read once
_MASKED = re.compile(rf"(?<![{_LETTER}{_SIGN}])[{_LETTER}]*+[{_SIGN}][{_LETTER}{_SIGN}]*+")
#: a run of one letter and the letters around it, as long as a word may be
_RUN = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?<=[^\W\d_])")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPLIT = re.compile(r"[.!?。！？]+(?=\s|$)|[。！？]|\n+|\s[-–—]\s")
_CHAT = re.compile(r"^\s*(?:<\w+>|[-*>#=|]+|q:|a:|//|\"\"\")\s*")


def restore(text: str, decoder: Decoder) -> str:
    """The text in plain letters with disguised words of abuse restored."""
    t = plain_letters(text)
    t = re.sub(r"\\[nrt](?=\w)", " ", t)

    def spaced(m: re.Match[str]) -> str:
        s = re.sub(r"[^\w]|_", "", m.group())
        w = s if s in decoder.all_words else decoder.decode(s)
        return w or _pieces(s, decoder) or m.group()

    def masked(m: re.Match[str]) -> str:
        s = m.group()
        core = s.strip(".,;:?")
        # runs are shortened before anything looks at the length; a mask stands for one letter, so those stay
        short = re.sub(r"([^*_•·])\1{2,}", r"\1\1", core) if len(core) > 24 else core
        if sum(c.isalpha() for c in short) < 1 or sum(c.isdigit() for c in short) > 0.75 * len(short):
            return s
        w = decoder.decode(short.rstrip("!")) or decoder.decode(short)
        return s.replace(core, w) if w else s

    def run(m: re.Match[str]) -> str:
        s = m.group()
        if not _TRIPLE.search(s):
            return s
        if len(set(s)) == 1:
            return s
        for k in (1, 2):
            w = re.sub(r"(.)\1{2,}", lambda x: x.group(1) * k, s)
            if w in decoder.all_words:
                return w
        return decoder.decode(re.sub(r"(.)\1{2,}", r"\1\1", s) if len(s) > 48 else s) or re.sub(r"(.)\1{2,}", r"\1", s)

    if _SPACED.search(t):
        t = _SPACED.sub(spaced, t)
    t = _MASKED.sub(masked, t)
    if _TRIPLE.search(t):
        t = _RUN.sub(run, t)
    return t


def _pieces(s: str, decoder: Decoder) -> str | None:
    """Spaced letters of several words: cut into words of the rules so that the fewest letters, then words, are left over."""
    best: list[tuple[int, int, int]] = [(0, 0, 0)]  # (letters left over, words, where the last piece begins) by end
    for end in range(1, len(s) + 1):
        n, k, _ = best[end - 1]
        here = (n + 1, k, end - 1)
        for at in range(max(0, end - decoder.longest), end - 2):
            if s[at:end] in decoder.all_words:
                here = min(here, (best[at][0], best[at][1] + 1, at))
        best.append(here)
    if not best[-1][1]:
        return None
    out, end = [], len(s)
    while end:
        at = best[end][2]
        out.append(s[at:end])
        end = at
    return " ".join(out[::-1])


# --- the score --------------------------------------------------------------------------------------------------------
_I = r"(?:" + "|".join(sorted(INSULTS, key=len, reverse=True)) + r"|pig|swine|piece of shit|pieces of shit|waste of oxygen|wastes of oxygen|waste of space|son of a bitch|sack of shit)(?:s|es)?"
_S = r"(?:" + "|".join(SCORN) + r")"
_D = "|".join(DOUBLE)
_GROUP_END = r"(?:vermin|parasites?|a disease|a plague|a cancer|subhuman|animals|rats|cockroaches|filth|scum|born thieves|savages|a burden)"
#: (pattern, weight). Weights of one sentence add up; what counts by itself has at least 0.5.
RULES: list[tuple[str, float]] = [
    # insults
    (rf"\b(?!(?:pigs?|losers?|scum|ticks?|swine|{_D})\b){_I}\b", 0.5),
    (rf"\b(?:{_D})\b", 0.2),
    (r"\b(?:pigs?|losers?|scum|pricks?|swine)\b", 0.3),
    (rf"\b(?:you|your|u|ur|yourself|youre)\b.{{0,60}}\b{_I}\b|\b{_I}\b.{{0,60}}\b(?:you|your)\b", 0.5),
    (rf"\b{_S} {_I}\b", 0.5),
    (rf"\b(?:shut up|get lost|listen|go away|hey|screw you|piss off|bugger off|you)[, ]+(?:you )?(?:{_S} )?{_I}\b", 0.5),
    (rf"\b(?:only|just|such|what) an? (?:{_S} )*{_I}\b|\bis an? (?:{_S} )*{_I}\b|\bwrites? .{{0,20}}than an? .{{0,24}}{_I}\b", 0.5),
    (rf"\byou (?:{_S}|{_I}),|\byou are (?:all |just |such |so |really )?(?:an? )?{_S}(?: people| excuse| person| human)?\b(?! at the)", 0.4),
    (r"\b(?:go )?fuck (?:you|yourself|off|u|them)\b|\bfuck your\b|\b(?:eat shit|suck my|kiss my ass|screw yourself|piss off)\b", 0.6),
    (r"\byou (?:people )?(?:make me sick|disgust me)\b|\beveryone laughs at you\b|\byour brain is (?:mush|mud|rotten)\b|\bdumber than\b.{0,20}\b(?:linter|rock|brick|door)|\bnobody (?:here )?(?:wants|likes|loves) you\b", 0.6),
    # contempt without a slur
    (r"\bpeople like you (?:are|is|make) (?:why|the reason|what)\b", 0.7),
    (r"\bmust be (?:so |really |very )?ashamed of\b|\bashamed of you\b", 0.7),
    (r"\bnot even your (?:mother|father|dog|parents|kids|family) (?:likes?|loves?|wants?) you\b|\bno(?:body| one) would (?:miss you|come to your funeral|cry for you|notice)\b", 0.7),
    (r"\bwe would all breathe easier\b|\b(?:us all|the world|everyone|everybody|humanity|mankind) a favou?r and\b", 0.6),
    (r"\b(?:now |just |please |so |and |go )(?:go )?(?:play in traffic|jump off a (?:bridge|cliff|roof|building)|crawl back under your rock|delete your account|disappear for good|kill yourself|drink bleach|hang yourself|drop dead)\b|\b(?:kill yourself|kys|go die|drop dead)\b", 0.7),
    (rf"\byou(?:'re| are|r) (?:all |just |really |truly |nothing but |such )*(?:an? |the |such an? )(?:(?!good|great|brave|lucky)\w+ ){{0,2}}(?:{'|'.join(NAMES)})s?\b(?! (?:to|if|not)\b)", 0.5),
    (r"\bi (?:really |truly |do |so )*(?:despise|hate|loathe|detest) you(?:r guts)?\b(?! know)|\b(?:despise|hate|loathe|detest) you with\b", 0.6),
    (r"\b(?:kill yourself|hang yourself|drown yourself|drink bleach|kys|go die|drop dead|go and die|end your(?: miserable| sorry)? life)\b", 0.7),
    (r"\b(?:jump (?:off|from|under) (?:a|the) (?:bridge|cliff|roof|building|train|bus))\b", 0.5),
    # threats and wishes of harm
    (r"\b(?:i|we)(?:'ll| will|'m going to| am going to|'re going to| are going to|'m gonna) (?:\w+ ){0,2}(?:kill|hurt|beat|stab|shoot|strangle|hunt|bury|drown|poison|choke|slap|punch) (?:you|u)\b", 0.7),
    (rf"\b(?:i|we|somebody|someone)(?:'ll| will|'m going to| am going to|'re going to| are going to| should| ought to) (?:\w+ ){{0,2}}(?:set|burn|torch|smash|break|cut|crush|destroy|visit|find|follow|slash) (?:\w+ )?(?:you|your) (?:{BELONGINGS})\b", 0.6),
    (r"\b(?:we|i) know (?:where you|which (?:\w+ )?you|your (?:address|kids|children|family|name|car|shift))\b", 0.6),
    (r"\bif i (?:ever )?(?:meet|see|find|catch|get) you\b", 0.6),
    (r"\byou will need an? (?:dentist|coffin|surgeon|wheelchair|doctor|ambulance|hospital|priest|undertaker)\b", 0.5),
    (r"\bwatch your back\b|\bwe know (?:where you live|your (?:shift|kids|address|name|family|car)|which (?:train|bus|way|car) you)\b|\bi know where you live\b", 0.6),
    (r"\bsomebody should (?:smash|break|set|drag|beat|punch|kick|burn|shoot|hang|slap|drown|stab|throw|run)\b.{0,60}\b(?:you|your)\b", 0.7),
    (r"\bsomebody should (?:explain|teach|show|tell) (?:it |that |this )?(?:to )?you\b.{0,40}\bwith (?:a |my |his |their )?(?:hammer|fist|fists|bat|boot|belt|axe|knife|gun)\b", 0.7),
    (r"\bshould be (?:slapped|shot|hanged|hung|beaten|locked away|locked up|fired on the spot|thrown|kicked|banned|whipped|burned|put down)\b", 0.3),
    (r"\b(?:smash your|break your|cut your|knock your|punch your) (?:teeth|fingers|legs|face|hands|neck|head|skull|nose|arms|knees)\b", 0.6),
    (r"\bi hope (?:that )?(?:you|your)\b.{0,60}\b(?:rot|die|choke|suffer|ditch|cancer|burn|truck|bleed|starve|drown|crash|grave|hit by|never wake|alone)\b", 0.7),
    (rf"\b(?:i|we)(?: will| am going to|'ll| are going to) (?:kill|hurt|beat|stab|shoot|find|burn|strangle|hunt) (?:you|your (?:\w+ )?(?:{BELONGINGS}))\b", 0.7),
    # hate against a group
    (r"\bthe sooner\b.{0,40}\b(?:vanish from|go back where|die out|are gone|are dead|leave this country|disappear from)\b", 0.7),
    (r"\b(?:belongs?|belonging) in (?:a|the) (?:cage|camp|zoo|kitchen|gutter|oven|jail|ghetto|asylum|swamp|stable|sewer|desert|trash)\b, not\b", 0.7),
    (rf"\b(?:are|is) (?:all |just |nothing but )?{_GROUP_END}\b(?! of)(?: and (?:must|deserve|should|have no|will|do not|cannot|need)\b)", 0.7),
    (rf"\bthey are (?:all |just |too )?(?:{_GROUP_END}|dishonest|primitive|dirty|stupid|inferior|born thieves)\b", 0.5),
    (r"\bwe should (?:ban|deport|wipe out|exterminate|get rid of|lock up|expel|remove|round up|throw out|kick out|gas)\b.{0,40}\b(?:for good|once and for all|they are|forever)\b", 0.7),
    (r"\btypical (?:of|for)\b.{0,30}: ?\w+, \w+(?:,)? and \w+|\btypical of\b.{0,40}\b(?:primitive|dishonest|dirty|worthless|inferior|stupid|lazy)\b", 0.7),
    (r"\bthey (?:breed like|ruin everything they touch|steal whatever|spoil the whole|cannot be trusted|are born thieves|should not be allowed|have no place|smell)\b", 0.6),
    (r"\b(?:has|have) no place in (?:this|our)\b|\bmust be kept away from our\b|\bdeserve whatever is coming\b|\bwill never be like us\b|\bno rights? here\b|\bare (?:too )?(?:inferior|subhuman)\b|\bare (?:vermin|subhuman)\b", 0.6),
    (r"\bi (?:take|accept|review|merge|want) no (?:\w+ )?(?:from|by)\b.{0,40}\btoo (?:dishonest|primitive|dirty|stupid|lazy|inferior)\b|\banother (?:patch|patches|commit|bug|pull request)\w* (?:by|from)\b.{0,40}\bno wonder\b", 0.6),
    # sexual
    (r"\b(?:" + "|".join(w for w in SEXUAL if w not in DOUBLE) + r")\b", 0.5),
    (r"\b(?:her|his|my|your|nice|wet|hard|big|suck|lick|see) (?:\w+ )?(?:tits|cock|dick|pussy|clit)\b", 0.5),
    (r"\b(?:strip|fuck|lick|spank|suck|ride|bend|undress|kiss|touch|pound|taste) (?:you|her|him|every inch|your)\b.{0,40}\b(?:naked|dry|beg|scream|desk|till|until|over|hard|inch|here|all night|deep)?", 0.4),
    (r"\bevery inch of you\b|\bsuck (?:you|him|me) dry\b|\bstrip you naked\b|\byou (?:lying )?naked\b|\btill you scream\b|\buntil you beg\b|\bbent over\b|\bride you\b|\bfuck (?:you|her|him|me)\b.{0,20}\b(?:until|till|on|right|hard)\b", 0.6),
    (r"\b(?:spread her legs|licked her|moaned|begged for more|tore off her|pushed (?:his|deep) |deep inside her|came as he|screamed with lust|fucked her|her (?:pussy|tits|legs|ass))\b", 0.6),
    (r"\b(?:hardcore|uncensored|explicit|dripping|wet|filthy|hot|free|live|adult) (?:sex|porn|xxx|nude|cam|clips|tapes|girls|wet)\b|\bsex (?:tapes|clips|cams?|show|dates?|near)\b|\bxxx (?:clips|tapes|videos?|pics|content|cams?)\b", 0.6),
    (r"\bsend (?:me )?(?:a |your |some )?(?:\w+ )?(?:pic|pics|photo|photos|video|videos|selfie|selfies|nudes?|picture)\b.{0,20}\b(?:of (?:you|your)|naked|tits|ass|nude|body)\b|\bdirtiest selfie\b|\byour nudes\b|\bnice (?:ass|rack|tits|boobs|legs|butt)\b|\bso (?:damn )?(?:hot|horny|sexy|fuckable)\b.{0,30}\bi bet\b|\bi bet she\b|\bready to be bent\b", 0.6),
    (r"\b(?:busty|lonely|bored|horny) (?:housewives|wives|singles|girls|women|milfs|teens)\b", 0.5),
    # other languages
    (r"\bhalt (?:die|deine) (?:fresse|schnauze|klappe)\b|\bverpiss dich\b|\bhoffentlich (?:verreckst|stirbst|krepierst)\b|\b(?:schreibt|macht|baut|liefert) so (?:einen|ein) (?:dreck|mist|müll|scheiß)|\bdu (?:\w+ )?(?:arschloch|schwein|mistvieh|idiot|stück scheiße|drecksau|wichser|hurensohn|trottel|vollidiot|missgeburt|penner|schlampe|fotze)\b|\b(?:arschloch|hurensohn|wichser|mistvieh|drecksau|missgeburt|stück scheiße|stück scheisse|vollidiot)\b|\bhier nichts verloren\b|\bleck mich\b|\bfick dich\b|\bgeh sterben\b", 0.7),
    (r"\b(?:hijo de puta|hijos de puta|hija de puta|pedazo de mierda|cabr[oó]n(?:es)?|gilipollas|pendejo|imb[eé]cil|maric[oó]n|zorra)\b|\bvete (?:a la mierda|al carajo|al infierno|a tomar)|\bc[aá]llate\b|\b(?:un|una|maldit[oa]|eres un) in[uú]til\b|\bin[uú]til de (?:mierda|\w)|\bnadie te quiere\b|\bde mierda\b|\bojal[aá] te mueras\b|\bmu[eé]rete\b|\bidiota\b|\bque te jodan\b", 0.7),
    (r"\b(?:encul[eé]|connard|connasse|salaud|salope|abruti|fils de pute|ordure|cr[eé]tin)s?\b|\bta gueule\b|\bva te faire\b|\bpersonne ne veut de toi\b|\bsale (?:imb[eé]cil|con|merde|idiot|chien|porc)|\bpauvre (?:imb[eé]cil|con|idiot|merde|type)|\bva crever\b|\bcr[eè]ve\b|\bimb[eé]cile\b|\bretourne d'où\b", 0.7),
    (r"傻逼|傻屄|煞笔|去死|滚出去|滚开|^滚|[，,]滚|白痴|废物|蠢猪|混蛋|王八蛋|操你|他妈的|妈的|贱人|婊子|你这个垃圾|就是个垃圾|你这种垃圾|脑残|狗屎|畜生|去你的|该死的|不得好死", 0.7),
    (r"死ね|クズ|カス[、め野はがよ。！]|カスめ|ゴミ[めは野]|ゴミ、|くたばれ|消えろ|黙れ|馬鹿野郎|バカ野郎|ばか野郎|クソ野郎|くそ野郎|二度と来るな|ぶっ殺|殺すぞ|きもい|キモい|無能な(?:クズ|カス|ゴミ|奴)|役立たず|あほ|アホ|まぬけ|売女|変態|糞", 0.7),
]
_RULES = [(re.compile(p), w) for p, w in RULES]


def _strings(items, most: int = 4000) -> tuple[set[str] | None, list[set[str]]]:
    """What a parsed pattern matches: (all its strings, or None where they can't be listed; sets of which each match holds a string)."""
    whole: set[str] | None = {""}
    run, sure = {""}, []
    for op, arg in items:
        name, here, inner = str(op), None, []
        if name == "LITERAL":
            here = {chr(arg)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            here = {chr(c) for _, c in arg}
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            here = {""}
        elif name == "SUBPATTERN":
            here, inner = _strings(arg[3], most)
        elif name == "BRANCH":
            got = [_strings(x, most) for x in arg[1]]
            if all(g is not None for g, _ in got):
                here = set().union(*(g for g, _ in got))
            elif all(i for _, i in got):
                inner = [set().union(*(_best(i) for _, i in got))]
        elif name == "MAX_REPEAT":
            got, inner = _strings(arg[2], most)
            here = got | {""} if got is not None and tuple(arg[:2]) == (0, 1) else None
            inner = inner if arg[0] else []
        if here is not None and len(run) * len(here) <= most:
            run = {x + y for x in run for y in here}
        else:
            sure.append(run)
            run = here or {""}
            whole = None
        sure += inner
    sure = [x for x in [*sure, run] if "" not in x]
    return (run if whole is not None else None), sure


def _best(sure: list[set[str]]) -> set[str]:
    return max(sure, key=lambda x: (min(map(len, x)), -len(x)))


def _needs(pattern: str) -> set[str]:
    """Strings of which every match of the pattern holds one, as far as each alternative allows."""
    parsed = re._parser.parse(pattern)
    alternatives = parsed[0][1][1] if len(parsed) == 1 and str(parsed[0][0]) == "BRANCH" else [parsed]
    return set().union(*(_best(_strings(x)[1]) for x in alternatives))


def _rule_words() -> set[str]:
    """The words of at least three letters that the rules list, without signs of any other kind."""
    out: set[str] = set()

    def walk(items) -> None:
        whole, sure = _strings(items)
        for strings in [*sure, whole or set()]:
            for x in strings:
                out.update(re.findall(r"[^\W\d_]{3,}", x))

    for p, _ in RULES:
        parsed = re._parser.parse(p)
        for x in parsed[0][1][1] if len(parsed) == 1 and str(parsed[0][0]) == "BRANCH" else [parsed]:
            walk(x)
    return {w for w in out if all(c in _AT for c in w)}


def _automaton():
    import ahocorasick

    rules: dict[str, list[int]] = {}
    for i, (p, _) in enumerate(RULES):
        for t in _needs(p):
            rules.setdefault(t, []).append(i)
    a = ahocorasick.Automaton()
    for t, at in rules.items():
        a.add_word(t, tuple(at))
    a.make_automaton()
    return a


_TRIGGER: list = []


def _candidates(text: str) -> set[int]:
    """The rules of which the text holds a string they need; no other rule can match."""
    if not _TRIGGER:
        _TRIGGER.append(_automaton())
    return {i for _, at in _TRIGGER[0].iter(text) for i in at}


def _worth_reading(text: str) -> bool:
    if not _TRIGGER:
        _TRIGGER.append(_automaton())
    return next(_TRIGGER[0].iter(text), None) is not None


def _tidy(s: str) -> str:
    return " ".join(s.replace("’", "'").replace("`", "").replace("*", "").split())


#: What a sentence is that only speaks of code or of the speaker.
_ABOUT_CODE = re.compile(r"\b(?:my (?:first |own |old )?(?:patch|code|fix|commit)|this (?:stupid |damn )?(?:bug|test|code|hack|function)|i (?:am|was|feel) (?:such )?an? |i hate (?:flaky|slow|this|these)|moderation filter|word list|wordlist|blocklist|the word|insult filter|profanity|dataset|said nobody ever|as a bug|quot(?:e|ed|ing))\b")


def score_sentence(s: str) -> float:
    total = 0.0
    for i in sorted(_candidates(s)):
        rx, w = _RULES[i]
        if rx.search(s):
            total += w
    if total and _ABOUT_CODE.search(s) and not re.search(r"\b(?:you|your|they)\b", s):
        total *= 0.4
    return min(1.0, total)


_TOKEN = re.compile(r"[^\W_]+")
_IDEOGRAPH = re.compile("[぀-ヿ㐀-鿿]")
LONGEST = 4


def tokens(sentence: str) -> list[str]:
    """Words but for numbers; of scripts without spaces each character."""
    out: list[str] = []
    for w in _TOKEN.findall(sentence):
        if _IDEOGRAPH.search(w):
            out += w
        elif not w.isdigit():
            out.append(w)
    return out


def phrases_of(sentence: str) -> set[str]:
    w = tokens(sentence)
    return {" ".join(w[i : i + n]) for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1)}


class Phrases:
    """What labelled documents taught: phrases that hardly any harmless document holds."""

    def __init__(self, phrases: set[str] = frozenset(), telling: set[str] = frozenset(), least_words: int = 3) -> None:
        self.phrases, self.telling, self.least_words = phrases, telling, least_words
        self.words = {w for p in phrases for w in p.split()}

    def may_score(self, text: str) -> bool:
        """Whether the text holds a telling word, without which no sentence of it scores."""
        return not self.telling.isdisjoint(_TOKEN.findall(text)) or bool(_IDEOGRAPH.search(text)) and not self.telling.isdisjoint(text)

    def score(self, sentence: str) -> float:
        """The share of the sentence's words that stand in learnt phrases, if there are at least ``least_words`` of them."""
        if not self.phrases:
            return 0.0
        w = tokens(sentence)
        if self.telling.isdisjoint(w):
            return 0.0
        known = [x in self.words for x in w]
        if sum(known) < max(self.least_words, len(w) / 2):
            return 0.0
        covered = bytearray(len(w))
        for n in range(1, LONGEST + 1):
            for i in range(len(w) - n + 1):
                if known[i] and " ".join(w[i : i + n]) in self.phrases:
                    covered[i : i + n] = b"\x01" * n
        n = sum(covered)
        return n / len(w) if n >= self.least_words else 0.0


NO_PHRASES = Phrases()


def sentences(text: str) -> Iterator[str]:
    """The sentences of a restored text, also of its lines joined, each once."""
    flat = re.sub(r"(?<!\n)\n(?!\n)", " ", text)
    seen: set[str] = set()
    for form in (text, flat) if flat != text else (text,):
        for s in _SPLIT.split(form):
            s = _tidy(_CHAT.sub("", s))
            if s and s not in seen:
                seen.add(s)
                yield s


def score(text: str | None, decoder: Decoder, learnt: Phrases = NO_PHRASES) -> float:
    """0 to 1: the strongest sentence of the restored text."""
    if not text or text.isspace():
        return 0.0
    t = restore(text, decoder)
    ruled, taught = _worth_reading(_tidy(t)), learnt.may_score(t)
    if not ruled and not taught:
        return 0.0
    best = 0.0
    for s in sentences(t):
        if ruled and best < 1 and _worth_reading(s):
            best = max(best, score_sentence(s))
        if taught and best < 1:
            best = max(best, learnt.score(s))
    return round(best, 4)


# --- on Spark --------------------------------------------------------------------------------------------------------
def char_counts(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all documents; a table of fixed size comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STATES**3, np.int64)
        table = np.zeros(0x250, np.int64)
        for c, i in _AT.items():
            if ord(c) < 0x250:
                table[ord(c)] = table[ord(c.upper()) if len(c.upper()) == 1 and ord(c.upper()) < 0x250 else ord(c)] = i
        for b in batches:
            joined = " ".join(x for x in b.column(0).to_pylist() if x)
            code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.where(code < 0x250, table[np.minimum(code, 0x24F)], 0)
            if len(at) > 2:
                total += np.bincount(at[:-2] * STATES * STATES + at[1:-1] * STATES + at[2:], minlength=STATES**3)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k], pa.int64())], ["k", "n"])

    rows = documents.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(STATES**3, np.int64)
    for r in rows:
        out[r["k"]] = r["n"]
    return out


_MADE: dict[str, tuple[Decoder, Phrases]] = {}


def _made(digest: str, counts: np.ndarray, phrases: list[str], telling: list[str]) -> tuple[Decoder, Phrases]:
    """Decoder and phrases, built once a worker."""
    if digest not in _MADE:
        _MADE.clear()
        _MADE[digest] = (Decoder(CharModel(counts)), Phrases(set(phrases), set(telling)))
    return _MADE[digest]


def _digest(*parts: bytes) -> str:
    return hashlib.blake2b(b"\0".join(parts), digest_size=16).hexdigest()


def learn(documents: DataFrame, labels: DataFrame, counts: np.ndarray, least: int = 4, purity: float = 0.9, most_labels: int = 50_000) -> tuple[list[str], list[str]]:
    """(phrases, telling words) of labelled documents, sorted; their number is bounded by the words of ``most_labels`` documents.

    The labels, at most ``most_labels`` short rows, are broadcast, so no text is shuffled but theirs. What enough abusive
    documents hold is counted first; of the others only that is counted, so what is shuffled is small.
    """
    verdict = labels.filter(F.col("abusive").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("abusive").alias("share")).filter("share <> 0.5")
    some = verdict.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).select("doc_id", (F.col("share") > 0.5).alias("abusive"))
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).select("text", "abusive")
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    digest = _digest(counts.tobytes())

    def holders(df: DataFrame, only) -> DataFrame:
        def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            decoder, _ = _made(digest, shared.value, [], [])
            wanted = None if only is None else only.value
            for b in batches:
                count: Counter[str] = Counter()
                for t in b.column(0).to_pylist():
                    held = set().union(*map(phrases_of, sentences(restore(t, decoder))))
                    count.update(held if wanted is None else held & wanted)
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["phrase", "n"])

        return df.select("text").mapInArrow(hold, "phrase string, n long").groupBy("phrase").agg(F.sum("n").alias("n"))

    yes = {r["phrase"]: r["n"] for r in holders(texts.filter("abusive"), None).filter(F.col("n") >= least).collect()}
    if not yes:
        return [], []
    no = {r["phrase"]: r["n"] for r in holders(texts.filter("not abusive"), spark.sparkContext.broadcast(frozenset(yes))).collect()}
    share = {p: n / (n + no.get(p, 0)) for p, n in yes.items()}
    return sorted(p for p, x in share.items() if x >= purity), sorted(p for p, x in share.items() if x > 0.5 and " " not in p)


def scores(documents: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, score) of every document; with ``labels`` (doc_id, abusive), by what they teach too."""
    spark = documents.sparkSession
    ship(spark)
    counts = char_counts(documents, text).astype(np.float32)
    src = documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    phrases, telling = learn(src, labels, counts) if labels is not None else ([], [])
    shared = spark.sparkContext.broadcast((counts, phrases, telling))
    digest = _digest(counts.tobytes(), "\n".join([*phrases, "", *telling]).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, learnt = _made(digest, *shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([score(t, decoder, learnt) for t in b.column(2).to_pylist()], pa.float64())], ["doc_id", "source", "score"])

    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, source string, score double").dropDuplicates(["doc_id"])


def rates(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """(source, documents, abusive, rate)."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= least).alias("abusive")).withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))
