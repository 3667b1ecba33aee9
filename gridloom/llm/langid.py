"""Languages of documents and of the segments of mixed ones by hyperdimensional profiles (problem 10).

Each character has a random +-1 vector; an n-gram's vector binds (multiplies) its characters'
vectors, each permuted (rolled) by its place; a profile bundles (sums) n-gram vectors. A segment is
compared with each language's prototype by cosine. As all of a segment's n-gram vectors meet the
same prototypes, their dot products are kept per n-gram, so a segment costs lookups and sums.

Prototypes are trained here, on a bounded sample of labelled documents. Labels are noisy, so
training relabels segments by their nearest prototype a few times and gives up classes whose
segments another class explains as well.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shipping import ship

DIMENSIONS = 2048
NGRAM = 3
SAMPLE_PER_LABEL = 400
LEAST_ROWS = 5
MOST_SEGMENTS, SEGMENT_CHARS = 60_000, 400
MARGIN = 0.07
FULL = 24
# ISO 639-1, 639-2 codes, English and own names of languages, one language a line.
LANGUAGES = """
en eng english
de deu ger german deutsch
fr fra fre french français francais
es spa spanish español espanol castellano
it ita italian italiano
pt por portuguese português portugues
nl nld dut dutch nederlands
sv swe swedish svenska
da dan danish dansk
no nor nb nob nn nno norwegian norsk
fi fin finnish suomi
pl pol polish polski
cs ces cze czech čeština
uk ukr ukrainian українська
ru rus russian русский
cy cym wel welsh cymraeg
ja jpn japanese 日本語
zh zho chi chinese 中文
ko kor korean 한국어
tr tur turkish türkçe
el ell gre greek ελληνικά
ar ara arabic العربية
hu hun hungarian magyar
ro ron rum romanian română
"""
# The first article of the Universal Declaration of Human Rights, which is in the public
# domain, in these languages; seeds of the prototypes where no document has a label.
SEEDS = """
en All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.
de Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen.
fr Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.
es Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.
it Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.
pt Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.
nl Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.
sv Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.
da Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd.
no Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd.
fi Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.
pl Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.
cs Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.
uk Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства.
ru Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.
cy Genir pawb yn rhydd ac yn gydradd â'i gilydd mewn urddas a hawliau. Fe'u cynysgaeddir â rheswm a chydwybod, a dylai pawb ymddwyn y naill at y llall mewn ysbryd cymodlon.
ja すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。
zh 人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。
ko 모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.
tr Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.
el Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.
ar يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء
hu Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.
ro Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.
"""
# Labels that name no language.
UNLABELLED = ["", "und", "unknown", "n/a", "na", "none", "null", "??", "?", "-", "zxx", "mis", "mul", "unk"]


def label_code(label: Column) -> Column:
    """ISO 639-1 code a language label names in any spelling; null for missing labels, the label itself if unknown."""
    names = {w: line.split()[0] for line in LANGUAGES.strip().splitlines() for w in line.split()}
    low = F.lower(F.trim(F.regexp_replace(label, r"[\s\p{Z}\p{Cf}]+", " ")))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    stem = F.regexp_extract(low, r"^(\p{L}+)[-_ (.]", 1)
    named = F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.nullif(stem, F.lit(""))), low)
    return F.when(~F.coalesce(low, F.lit("")).isin(*UNLABELLED), named)


_LOG_HEAD = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d(?::\d\d)?[^\s]*\s+(?:(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b\s*)?(?:\[[^\]]*\]\s*)?|\[\d\d:\d\d(?::\d\d)?\]\s*(?:#\d+|<[^>]*>)?\s*)")
_CODE_LINE = re.compile(
    r"^\s*\||[A-Za-z_]\((?!s\))|\(\*\)|^\s*(?:def|class|import|return|from\s+\w+\s+import)\b.*[:()=.]\s*|[-+*/<>=!]=|^\s*[{}\[\]]+\s*$|^\s*\{.*[:}]|\w\s*=\s*[{\[\w'\"]|;\s*$|^\s*SELECT\s.*(?:\bFROM\b|[;*])|^\s*DELETE\s+FROM\b|^\s*(?:INSERT|UPDATE|DELETE|CREATE|WITH)\s.*[(=;*]|^```"
)
# Lines that are program text as a whole, however many words they hold.
_STATEMENT = re.compile(r"^\s*(?:[|{}\[\]#/*]|(?:def|class|import|return|from|if|for|while|else|elif|try|with|print|SELECT|INSERT|UPDATE|DELETE|CREATE|WITH)\b.*[(=;*:]|SELECT\s|DELETE\s+FROM\b)|\bFROM\b.*\b(?:WHERE|JOIN|GROUP)\b")
# Calls, comparisons, assignments and a closing semicolon inside a line of prose.
_CODE_PART = re.compile(r"\S*[A-Za-z]\((?:[^()]|\([^()]*\))*\)\S*|\S+\s*(?:[-+*/<>=!]=|=)\s*\S+|;\s*$")
_CODE_LEFT = re.compile(r"[=|{}\[\]<>();]")
PROSE_WORDS = 6
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_NOISE = re.compile(r"(?<![A-Za-z])[A-Za-z]*+\d[A-Za-z0-9_.,:/-]*|https?://\S+|(?<!\S)[^\s@]++@\S+|\b[\w-]++\.(?:csv|zip|json|parquet|txt|xml|sql|py|log)\b|`[^`\n]*`|\b[^\W_]++_\w+|\bk[Ww]+h\b|\bHH\?")
_SENTENCE = re.compile(r"(?<=[.!?。！？…])[\"'»”)]*(?:\s+|(?<=[。！？]))")
_WORDS = re.compile(r"[^\W\d_]+")
SHORT = 16
_HEADS = frozenset("[0123456789")
# Without one of these a line is no program text.
_CODE_SIGNS, _CODE_WORDS = frozenset("|(=;{}[]*`"), ("def", "class", "import", "return", "from", "SELECT", "DELETE", "INSERT", "UPDATE", "CREATE", "WITH")
_TICKED = re.compile(r"`[^`\n]*`")
CACHED_WORDS, CACHED_SEGMENTS, CACHED_CHARS = 400_000, 100_000, 40_000_000
_clean: dict[str, str] = {}


_HIGH_RUN = re.compile(r"[^\x00-\x7f]{2,}")


def repaired(text: str) -> str:
    """Undo UTF-8 read as a one-byte code page, run by run; sound text does not change.

    A run of characters is repaired if its one-byte form is UTF-8, for long runs up to a quarter
    of lost bytes.
    """

    def undo(match: re.Match) -> str:
        run = match[0]
        raw = bytearray()
        for ch in run:
            try:
                raw += ch.encode("cp1252")
            except UnicodeEncodeError:
                if ord(ch) > 255:
                    return run
                raw.append(ord(ch))
        fixed = raw.decode("utf-8", "replace")
        lost = fixed.count("\ufffd")
        return fixed if not lost or (len(fixed) >= 8 and lost * 4 <= len(fixed)) else run

    return _HIGH_RUN.sub(undo, text)


def _prose_left(line: str) -> str:
    """What is left of a line with program text: its prose of ``PROSE_WORDS`` words or more, else nothing."""
    if _STATEMENT.search(line):
        return ""
    rest = _CODE_PART.sub(" ", line)
    return rest if len(_WORDS.findall(rest)) >= PROSE_WORDS and not _CODE_LEFT.search(rest) else ""


def _letters(word: str) -> str:
    """The lower-case runs of letters of a piece of text without codes and figures; short pieces are kept for the next time."""
    if len(word) > 40:
        return " ".join(_WORDS.findall(_NOISE.sub(" ", word).lower()))
    if len(_clean) > CACHED_WORDS:
        _clean.clear()
    found = _clean[word] = " ".join(_WORDS.findall(_NOISE.sub(" ", word).lower()))
    return found


def _cleaned(sentence: str) -> str:
    """The words of a sentence. No pattern of noise but quoted code reaches over white space, so words are cleaned one by one."""
    known = _clean.get
    out = []
    for word in sentence.split():
        found = known(word)
        if found is None:
            found = _letters(word)
        if found:
            out.append(found)
    return " ".join(out)


def prose_segments(text: str) -> list[tuple[int, str]]:
    """(line number, cleaned lower-case words) of each sentence of prose.

    Log heads, codes, figures, mark-up and program lines are dropped, of a line of prose with program
    text in it only that text; pieces of fewer than
    ``SHORT`` letters join the sentence before them on their line, or after.
    """
    out: list[tuple[int, str]] = []
    fenced = False
    if not text.isascii():
        text = repaired(text)
    for no, line in enumerate(text.split("\n"), 1):
        start = line.lstrip()
        if not start:
            continue
        if start.startswith("```"):
            fenced = not fenced
            continue
        if fenced:
            continue
        body = _LOG_HEAD.sub("", line, count=1) if start[0] in _HEADS else line
        if "&" in body:
            body = html.unescape(body)
        if "<" in body:
            body = _TAG.sub(" ", body)
        body = body.rstrip()
        if (not _CODE_SIGNS.isdisjoint(body) or body.lstrip().startswith(_CODE_WORDS)) and _CODE_LINE.search(body):
            body = _prose_left(body)
        if "`" in body:
            body = _TICKED.sub(" ", body)
        pieces: list[str] = []
        waiting = ""
        for sentence in _SENTENCE.split(body):
            words = _cleaned(sentence)
            if not words:
                continue
            if waiting:
                words, waiting = f"{waiting} {words}", ""
            if len(words) < SHORT and len(words.encode()) < SHORT:
                if pieces:
                    pieces[-1] += " " + words
                else:
                    waiting = words
            else:
                pieces.append(words)
        if waiting:
            pieces.append(waiting)
        out += [(no, p) for p in pieces]
    return out


@dataclass
class Profiles:
    """Language prototypes and the per-n-gram dot products with them."""

    langs: list[str]
    prototypes: np.ndarray  # languages x dimensions, centred and of unit length
    seed: int = 7
    letters: dict[int, np.ndarray] = field(default_factory=dict)
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # known n-grams, sorted
    dots: np.ndarray | None = None  # their dot products, in the same order
    seen: dict[str, int] = field(default_factory=dict)
    kept: np.ndarray | None = None  # cosines of seen segments
    chars: int = 0

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, DIMENSIONS, dtype=np.int8)
            v = self.letters[code] = bits * np.int8(2) - np.int8(1)
        return v

    def ngrams(self, grams: np.ndarray) -> np.ndarray:
        """Bound vectors of n-grams packed as 21 bits a character: each character's vector rolled by its place."""
        parts = [grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF]
        codes, at = np.unique(np.concatenate(parts), return_inverse=True)
        vectors = np.stack([self.letter(int(c)) for c in codes])
        n = len(grams)
        return np.roll(vectors, 2, axis=1)[at[:n]] * np.roll(vectors, 1, axis=1)[at[n : 2 * n]] * vectors[at[2 * n :]]

    def rows_of(self, grams: np.ndarray) -> np.ndarray:
        """Dot products with the prototypes of sorted distinct n-grams, made where missing."""
        if len(self.grams) > 1_000_000:  # a memory bound, not a limit of vocabulary: entries are made again
            self.grams, self.dots = np.zeros(0, np.int64), None
        at = np.searchsorted(self.grams, grams)
        missing = np.ones(len(grams), bool)
        inside = at < len(self.grams)
        missing[inside] = self.grams[at[inside]] != grams[inside]
        if missing.any():
            fresh = grams[missing]
            made = np.empty((len(fresh), len(self.langs)), np.float32)
            for i in range(0, len(fresh), 2048):
                made[i : i + 2048] = self.ngrams(fresh[i : i + 2048]).astype(np.float32) @ self.prototypes.T
            if self.dots is None:
                self.grams, self.dots = fresh, made
            else:
                self.grams, self.dots = np.insert(self.grams, at[missing], fresh), np.insert(self.dots, at[missing], made, axis=0)
            at = np.searchsorted(self.grams, grams)
        return self.dots[at]

    def cosines(self, segments: list[str]) -> np.ndarray:
        """segments x languages cosines; a segment's length is taken from its n-gram counts,
        which random high-dimensional vectors keep up to a small error."""
        if not segments:
            return np.zeros((0, len(self.langs)), np.float32)
        grams, owner = packed_ngrams(segments)
        distinct, back = np.unique(grams, return_inverse=True)
        pairs, counts = np.unique(owner * len(distinct) + back, return_counts=True)
        owner, back = pairs // len(distinct), pairs % len(distinct)
        weighted = self.rows_of(distinct)[back] * np.sqrt(counts).astype(np.float32)[:, None]
        starts = np.searchsorted(owner, np.arange(len(segments)))
        sums = np.add.reduceat(weighted, starts, axis=0)  # each segment has an n-gram: it is padded
        norm = np.sqrt(np.bincount(owner, counts, len(segments)) * DIMENSIONS)
        return (sums / norm[:, None]).astype(np.float32)

    def cached_cosines(self, segments: list[str]) -> np.ndarray:
        """The same, for segments that recur: their rows are kept for the next batches."""
        if self.kept is None or len(self.seen) > CACHED_SEGMENTS or self.chars > CACHED_CHARS:
            self.seen, self.kept, self.chars = {}, np.zeros((4096, len(self.langs)), np.float32), 0
        fresh = [s for s in dict.fromkeys(segments) if s not in self.seen]
        if fresh:
            used, need = len(self.seen), len(self.seen) + len(fresh)
            if need > len(self.kept):
                self.kept = np.concatenate([self.kept[:used], np.zeros((max(need, 2 * used) - used, len(self.langs)), np.float32)])
            self.kept[used:need] = self.cosines(fresh)
            self.seen.update(zip(fresh, range(used, need)))
            self.chars += sum(map(len, fresh))
        return self.kept[np.fromiter(map(self.seen.__getitem__, segments), np.int64, len(segments))]


def packed_ngrams(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed character trigrams of all segments, padded by blanks, and the segment each is of."""
    padded = [f" {s} " for s in segments]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.array([len(p) for p in padded])
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(padded)), lengths)
    grams = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    inside = np.arange(len(codes) - 2) + 2 < ends[owner[:-2]]
    return grams[inside], owner[:-2][inside]


def _bundle(maker: Profiles, segments: list[str], times: np.ndarray, label: np.ndarray, classes: int) -> np.ndarray:
    """Sum of square-rooted n-gram counts times n-gram vectors, for each class."""
    grams, owner = packed_ngrams(segments)
    distinct, back = np.unique(grams, return_inverse=True)
    counts = np.bincount(label[owner] * len(distinct) + back, times[owner], minlength=classes * len(distinct)).reshape(classes, len(distinct))
    roots = np.sqrt(counts).astype(np.float32)
    total = np.zeros((classes, DIMENSIONS), np.float32)
    for at in range(0, len(distinct), 2048):
        total += roots[:, at : at + 2048] @ maker.ngrams(distinct[at : at + 2048]).astype(np.float32)
    return total


def _unit(total: np.ndarray) -> np.ndarray:
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


def _centred(total: np.ndarray) -> np.ndarray:
    """Unit prototypes less their mean, which holds what all languages share, of unit length again."""
    unit = _unit(total)
    return _unit(unit - unit.mean(axis=0)) if len(unit) > 1 else unit


def _recentred(raw: np.ndarray, unit: np.ndarray, among: list[int]) -> np.ndarray:
    """Cosines with prototypes centred among some classes, from the cosines with uncentred ones."""
    gram = unit[among] @ unit[among].T
    length = np.sqrt(np.maximum(np.diag(gram) - 2 * gram.mean(axis=1) + gram.mean(), 1e-9))
    picked = raw[:, among]
    return (picked - picked.mean(axis=1, keepdims=True)) / length


def train(labelled: list[tuple[str, str]], sizes: dict[str, int] | None = None, **kw) -> Profiles:
    """Prototypes from (label, text) pairs with noisy labels."""
    pairs = Counter((label, s) for label, text in labelled for s in dict.fromkeys(s for _, s in prose_segments(text)))
    return train_segments([(label, s, n) for (label, s), n in pairs.items()], sizes or Counter(label for label, _ in labelled), **kw)


def train_segments(counted: list[tuple[str, str, int]], sizes: dict[str, int], rounds: int = 4, explained: float = 0.75) -> Profiles:
    """Prototypes from (label, segment, documents) with noisy labels.

    Each round moves segments that another prototype fits better by ``MARGIN`` and bundles the
    prototypes anew. A class is given up, smallest first, when its labelled segments fit larger
    classes nearly as well (``explained``) as those classes' own do: then its label is a wrong
    name for them. ``sizes`` are the labels' frequencies in the corpus.
    """
    labels, segments, times = [c for c, _, _ in counted], [s for _, s, _ in counted], np.array([n for _, _, n in counted])
    langs = sorted({*labels})
    if not langs:
        return Profiles(["und"], np.zeros((1, DIMENSIONS), np.float32))
    given = np.array([langs.index(c) for c in labels])
    assigned = given.copy()
    maker = Profiles([], np.zeros((0, DIMENSIONS), np.float32))
    for _ in range(rounds):
        unit = _unit(_bundle(maker, segments, times, assigned, len(langs)))
        raw = Profiles(langs, unit, letters=maker.letters).cosines(segments)
        scores = _recentred(raw, unit, list(range(len(langs))))
        best = scores.argmax(axis=1)
        alive = list(range(len(langs)))
        rank = sorted(range(len(langs)), key=lambda c: (sizes.get(langs[c], 0), langs[c]))
        for place, c in enumerate(rank[:-1]):
            mine, larger = given == c, rank[place + 1 :]
            if mine.any() and len(larger) > 1:
                without = _recentred(raw, unit, larger)  # as if this class had never been named
                level = np.array([np.median(np.repeat(without[best == o, i], times[best == o])) if (best == o).any() else 1 for i, o in enumerate(larger)])
                nearest = without[mine]
                fit = np.median(np.repeat(nearest.max(axis=1) / np.maximum(level[nearest.argmax(axis=1)], 1e-6), times[mine]))
                if fit <= explained:
                    continue
            elif mine.any():
                continue
            alive.remove(c)
        kept = scores[:, alive]
        number = np.full(len(langs) + 1, -1)
        number[alive] = np.arange(len(alive))
        given = number[given]
        top = kept.argmax(axis=1)
        stay = (given >= 0) & (kept.max(axis=1) - kept[np.arange(len(kept)), np.maximum(given, 0)] <= MARGIN)
        assigned = np.where(stay, given, top)
        langs = [langs[c] for c in alive]
    return Profiles(langs, _centred(_bundle(maker, segments, times, assigned, len(langs))))


def train_unlabelled(segments: list[tuple[str, int]], rounds: int = 1, least_share: float = 0.003) -> Profiles:
    """Prototypes where no document has a label: clusters of (segment, documents), begun from ``SEEDS``.

    Each round bundles the prototypes anew from their seeds and the segments that fit one of them
    more clearly than the median segment does. A language that fits fewer than ``least_share`` of
    those at first is given up.
    """
    seeds = [line.split(" ", 1) for line in SEEDS.strip().splitlines()]
    langs, first = [c for c, _ in seeds], [_cleaned(t) for _, t in seeds]
    texts, times = [s for s, _ in segments], np.array([n for _, n in segments], np.int64)
    maker = Profiles([], np.zeros((0, DIMENSIONS), np.float32))
    unit = _centred(_bundle(maker, first, np.ones(len(first), np.int64), np.arange(len(langs)), len(langs)))
    for turn in range(rounds if segments else 0):
        scores = Profiles(langs, unit, letters=maker.letters).cosines(texts)
        ranked = np.sort(scores, axis=1)
        gap = ranked[:, -1] - ranked[:, -2] if len(langs) > 1 else ranked[:, -1]
        best, usual = scores.argmax(axis=1), np.median(gap)
        sure = gap >= usual
        held = np.bincount(best[sure], times[sure], len(langs))
        alive = np.flatnonzero(held >= least_share * held.sum()) if not turn else np.arange(len(langs))
        number = np.full(len(langs), -1)
        number[alive] = np.arange(len(alive))
        first, langs = [first[c] for c in alive], [langs[c] for c in alive]
        at = np.flatnonzero(sure & (number[best] >= 0))
        unit = _centred(_bundle(maker, [*first, *[texts[i] for i in at]], np.concatenate([np.ones(len(first), np.int64), times[at]]), np.concatenate([np.arange(len(first)), number[best[at]]]), len(langs)))
    return Profiles(langs, unit)


def margins(weight: np.ndarray, margin: float = MARGIN, full: int = FULL) -> np.ndarray:
    """By how much of cosine a segment of so many bytes must fit another language better to be in it: the
    shorter it is below ``full`` bytes, the more, as cosines of few n-grams scatter more."""
    return margin * np.maximum(1.0, full / np.maximum(weight, 1))


def judge(texts: list[str | None], profiles: Profiles, margin: float = MARGIN, level: float = 0.18) -> list[list[tuple[int, str, float]]]:
    """For each text its (line number, language, confidence) rows; line 0 is the whole text.

    Lines appear only where prose stands in a second language, better by ``margins`` than in the
    first, at a cosine of ``level`` or more. A line's confidence is that of all its prose in the
    language. Texts without words give no rows.
    """
    pieces = [prose_segments(t) if t else [] for t in texts]
    flat = [s for own in pieces for _, s in own]
    count = np.array([len(own) for own in pieces], np.int64)
    out: list[list[tuple[int, str, float]]] = [[] for _ in texts]
    if not flat:
        return out
    langs, rows = profiles.langs, profiles.cached_cosines(flat)
    held = np.flatnonzero(count)
    owner = np.repeat(np.arange(len(held)), count[held])
    starts = np.concatenate([[0], np.cumsum(count[held])[:-1]])
    size = np.array([len(s) - s.count(" ") for s in flat])
    weight = np.array([len(s.encode()) for s in flat])
    overall = np.add.reduceat(rows * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
    leader = overall.argmax(axis=1)
    top, first = rows.max(axis=1), rows[np.arange(len(rows)), leader[owner]]
    firm = (top - first > margins(weight, margin)) & (top > level)
    lang = np.where(firm, rows.argmax(axis=1), leader[owner])
    amount = np.zeros((len(held), len(langs)))
    np.add.at(amount, (owner, lang), size)
    main = amount.argmax(axis=1)
    share = amount.max(axis=1) / np.maximum(amount.sum(axis=1), 1)
    sure = lambda r, c: 1 / np.exp(12 * (r - r[np.arange(len(r)), c][:, None])).sum(axis=1)
    whole = sure(overall, main) * share
    mixed = (amount > 0).sum(axis=1) > 1
    for i, doc in enumerate(held):
        out[doc].append((0, langs[main[i]], round(float(whole[i]), 4)))
        if mixed[i]:
            lo = starts[i]
            by_line: dict[tuple[int, int], list[int]] = {}
            for k, (no, _) in enumerate(pieces[doc]):
                by_line.setdefault((no, int(lang[lo + k])), []).append(lo + k)
            for (no, c), at in sorted(by_line.items()):
                own = weight[at] @ rows[at] / weight[at].sum()
                out[doc].append((no, langs[c], round(float(sure(own[None, :], np.array([c]))[0]), 4)))
    return out


def _segments_of(coded: DataFrame, per_class: int, chars: int = SEGMENT_CHARS) -> list:
    """At most ``per_class`` distinct segments of each class of (c, t) rows, with the documents they are in.

    Segments are cut out on the executors, the longest into pieces of ``chars`` characters, counted
    there, and chosen by a hash, so the driver receives a bounded sample whatever the texts' lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = Counter((c, s[i : i + chars]) for c, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for s in {s for _, s in prose_segments(t)} for i in range(0, len(s), chars))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.string()), pa.array([s for _, s in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["c", "s", "n"])

    counted = coded.mapInArrow(run, "c string, s string, n bigint").groupBy("c", "s").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.xxhash64("s", F.lit(23)), "s"))
    return counted.withColumn("place", place).where(F.col("place") <= per_class).orderBy("c", "s").select("c", "s", "n").collect()


def fit_profiles(documents: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = SAMPLE_PER_LABEL, least: int = LEAST_ROWS, most_segments: int = MOST_SEGMENTS) -> Profiles:
    """Train on about ``per_label`` documents of each label code, chosen by a hash of their key.

    Every code of at least ``least`` documents is a class, or every code where none has so many;
    the codes share ``most_segments`` distinct segments, at least 50 each. Without any label,
    prototypes are grown from seeds on as many segments of the corpus (``train_unlabelled``).
    """
    ship(documents.sparkSession)
    coded = documents.select(F.col(key).alias("k"), label_code(F.col(label)).alias("c"), F.col(text).alias("t")).where(F.length("t") > 0)
    named = coded.where(F.col("c").isNotNull()).groupBy("c").agg(F.count("*").alias("n"))
    sizes = {r.c: r.n for r in named.where(F.col("n") >= least).collect()} or {r.c: r.n for r in named.orderBy("c").collect()}
    if not sizes:
        total = coded.count()
        drawn = coded.where(F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1_000_000)) < F.lit(min(1.0, 40 * per_label / max(total, 1)) * 1_000_000))
        found = _segments_of(drawn.select(F.lit("").alias("c"), "t"), most_segments)
        return train_unlabelled([(r.s, r.n) for r in found])
    share = documents.sparkSession.createDataFrame([(c, min(1.0, per_label / n) * 1_000_000) for c, n in sizes.items()], "c string, share double")
    drawn = coded.join(F.broadcast(share), "c").where(F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1_000_000)) < F.col("share"))
    found = _segments_of(drawn.select("c", "t"), max(50, most_segments // len(sizes)))
    return train_segments([(r.c, r.s, r.n) for r in found], sizes)


def languages(documents: DataFrame, profiles: Profiles, text: str = "text", label: str = "lang", key: str = "doc_id", step: int = 256) -> DataFrame:
    """(key, label_code, line_no, lang, confidence): line 0 for each document with words, lines for mixed ones.

    Null, empty and wordless texts give no rows; whole texts are judged, however long.
    """
    ship(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast((profiles.langs, profiles.prototypes))  # languages x 2048 floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(*shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = judge(part.column(2).to_pylist(), own)
                take = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
                rows = [r for own_rows in found for r in own_rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())],
                    names=["key", "label_code", "line_no", "lang", "confidence"],
                )

    src = documents.select(F.col(key).alias("key"), label_code(F.col(label)).alias("label_code"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {kind}, label_code string, line_no bigint, lang string, confidence double").withColumnRenamed("key", key)


def wrong_labels(judged: DataFrame) -> DataFrame:
    """Line 0 where the label is missing or names another language, and all lines of mixed documents."""
    return judged.where((F.col("line_no") > 0) | F.col("label_code").isNull() | (F.col("label_code") != F.col("lang")))
