"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, decoding, labelled examples."""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path
from random import Random

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)

LETTERS = "abcdefghijklmnopqrstuvwxyz"
UNUSED, OTHER, UPPER, DIGIT, SUMMED = range(5)
SYMBOLS = {c: k for k, c in enumerate(LETTERS + " \n@.-+()[]_%:/,;'\"=!?#$&*{}<>", 5)}
SIZE = 5 + len(SYMBOLS)
#: The symbol of each character below 127; the last stands for all others.
OF_CHARACTER = np.array([SYMBOLS.get(chr(c), UPPER if chr(c).isupper() else DIGIT if chr(c).isdigit() else OTHER) for c in range(127)] + [OTHER], np.int8)

#: Digits of a card number and its groups at most, and what may stand between two of them.
CARD_DIGITS, CARD_GROUPS = range(14, 20), 5
NUMBER, BETWEEN = re.compile("[0-9]+"), re.compile(" ?[ ./-]? ?")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def summed(text: str) -> list[tuple[int, int]]:
    """Where neighbouring numbers have, together, as many digits as a card and its checksum."""
    found, before = [], []
    for m in NUMBER.finditer(text):
        if before and not (m.start() - before[-1].end() <= 3 and BETWEEN.fullmatch(text, before[-1].end(), m.start())):
            before = []
        before = [*before[1 - CARD_GROUPS :], m]
        size = 0
        for k in range(len(before) - 1, -1, -1):
            size += before[k].end() - before[k].start()
            if size >= CARD_DIGITS.stop:
                break
            if size in CARD_DIGITS and luhn("".join(x.group() for x in before[k:])):
                found.append((before[k].start(), m.end()))
    return found


def symbols(text: str) -> np.ndarray:
    """The model's symbol of each character: letters in lower case one by one, upper case, digits and others as one.

    Digits that pass a card's checksum have a symbol of their own, as no reading of digits as such shows that.
    """
    out = OF_CHARACTER[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 127)]
    for a, b in summed(text):
        out[a:b][out[a:b] == DIGIT] = SUMMED
    return out


def allowed() -> np.ndarray:
    """Transitions from a tag to a tag: an I follows only B or I of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


STARTS = np.array([0.0] + [0.0, -1e4] * len(KINDS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def initial(width: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"emb": draw(SIZE, width) * 2, "out": draw(2 * hidden, TAGS), "bias": np.zeros(TAGS), "moves": np.zeros((TAGS, TAGS))}
    for way in "fb":
        p |= {f"x{way}": draw(width, 4 * hidden), f"h{way}": draw(hidden, 4 * hidden), f"c{way}": np.zeros(4 * hidden)}
        p[f"c{way}"][hidden : 2 * hidden] = 1
    return p



def _lstm(p: dict, way: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (batch, time, hidden) of one direction, and what its gradient needs."""
    if way == "b":
        x = x[:, ::-1]
    n, steps, _ = x.shape
    hidden = p["h" + way].shape[0]
    given = x @ p["x" + way] + p["c" + way]
    h, c = np.zeros((n, hidden), x.dtype), np.zeros((n, hidden), x.dtype)
    out, kept = np.empty((n, steps, hidden), x.dtype), []
    for t in range(steps):
        z = given[:, t] + h @ p["h" + way]
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        kept.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[:, t] = h
    return (out[:, ::-1] if way == "b" else out), [x, kept]


def _lstm_back(p: dict, way: str, d: np.ndarray, kept: list, grads: dict) -> np.ndarray:
    x, states = kept
    if way == "b":
        d = d[:, ::-1]
    n, steps, hidden = d.shape
    dz = np.empty((n, steps, 4 * hidden), d.dtype)
    dh, dc = np.zeros((n, hidden), d.dtype), np.zeros((n, hidden), d.dtype)
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, g, tc = states[t]
        dh = dh + d[:, t]
        dc = dc + dh * o * (1 - tc**2)
        at = dz[:, t]
        at[:, :hidden] = dc * g * i * (1 - i)
        at[:, hidden : 2 * hidden] = dc * before * f * (1 - f)
        at[:, 2 * hidden : 3 * hidden] = dh * tc * o * (1 - o)
        at[:, 3 * hidden :] = dc * i * (1 - g**2)
        grads["h" + way] += h.T @ at
        dh, dc = at @ p["h" + way].T, dc * f
    grads["x" + way] += x.reshape(-1, x.shape[2]).T @ dz.reshape(-1, 4 * hidden)
    grads["c" + way] += dz.sum((0, 1))
    dx = dz @ p["x" + way].T
    return dx[:, ::-1] if way == "b" else dx


def emissions(p: dict, x: np.ndarray) -> tuple[np.ndarray, list]:
    e = p["emb"][x]
    f, kept_f = _lstm(p, "f", e)
    b, kept_b = _lstm(p, "b", e)
    both = np.concatenate([f, b], 2)
    return both @ p["out"] + p["bias"], [both, kept_f, kept_b]


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def _sums(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log sums over the paths up to each tag, over those behind it, and over all."""
    steps = scores.shape[1]
    ahead = np.empty_like(scores)
    ahead[:, 0] = STARTS + scores[:, 0]
    for t in range(1, steps):
        ahead[:, t] = _logsum(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t]
    behind = np.zeros_like(scores)
    for t in range(steps - 2, -1, -1):
        behind[:, t] = _logsum(moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
    total = _logsum(ahead[:, -1], 1)
    return ahead, behind, total


def loss_and_grads(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of tags y (batch, time) under the CRF, and its gradient."""
    scores, (both, kept_f, kept_b) = emissions(p, x)
    n, steps, _ = scores.shape
    scores, moves = scores.astype(np.float64), np.where(allowed(), p["moves"].astype(np.float64), -1e4)
    ahead, behind, total = _sums(scores, moves)
    rows = np.arange(n)[:, None]
    gold = scores[rows, np.arange(steps), y].sum(1) + moves[y[:, :-1], y[:, 1:]].sum(1)
    d = np.exp(ahead + behind - total[:, None, None])
    d[rows, np.arange(steps), y] -= 1
    d /= n
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    pairs = np.exp(ahead[:, :-1, :, None] + moves + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum((0, 1)) / n
    np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1 / n)
    grads["moves"] = pairs * allowed()
    grads["out"] = both.reshape(-1, both.shape[2]).T @ d.reshape(-1, TAGS)
    grads["bias"] = d.sum((0, 1))
    back = d.astype(both.dtype) @ p["out"].T
    hidden = back.shape[2] // 2
    de = _lstm_back(p, "f", back[:, :, :hidden], kept_f, grads) + _lstm_back(p, "b", back[:, :, hidden:], kept_b, grads)
    np.add.at(grads["emb"], x.ravel(), de.reshape(-1, de.shape[2]))
    return float((total - gold).mean()), grads


def decode(p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best tags (batch, time) by Viterbi, and each one's marginal probability; that of rows without a span isn't reckoned (1)."""
    scores, _ = emissions(p, x)
    n, steps, _ = scores.shape
    moves = np.where(allowed(), p["moves"], -1e4).astype(scores.dtype)
    best, came = STARTS.astype(scores.dtype) + scores[:, 0], np.empty((n, steps, TAGS), np.int8)
    for t in range(1, steps):
        ways = best[:, :, None] + moves
        came[:, t] = ways.argmax(1)
        best = ways.max(1) + scores[:, t]
    tags = np.empty((n, steps), np.int64)
    tags[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = came[np.arange(n), t, tags[:, t]]
    likely, some = np.ones((n, steps)), np.flatnonzero((tags > 0).any(1))
    if some.size:
        ahead, behind, total = _sums(scores[some].astype(np.float64), moves.astype(np.float64))
        chances = np.exp(ahead + behind - total[:, None, None])
        likely[some] = chances[np.arange(some.size)[:, None], np.arange(steps), tags[some]]
    return tags, likely


def _word(rng: Random, least: int = 2, most: int = 9) -> str:
    return "".join(rng.choices(LETTERS, k=rng.randrange(least, most)))


#: Letters that the model reads as one symbol, and short words, which are most of what stands beside numbers and marks.
ACCENTED = "éèêçàñóíüößäđươ"
SHORT_WORDS = ("of", "the", "at", "in", "to", "on", "an", "and", "it", "is", "de", "la", "le", "el", "y", "et", "und", "der", "die", "dot", "a", "for", "with", "that", "I", "on the", "at the")


def _running(rng: Random) -> str:
    """A word of running text."""
    draw = rng.random()
    if draw < 0.25:
        return rng.choice(SHORT_WORDS)
    word = _word(rng, 1, 10)
    if draw < 0.45:
        at = rng.randrange(len(word) + 1)
        word = word[:at] + rng.choice(ACCENTED) + word[at + rng.randrange(2) :]
    return word


def _digits(rng: Random, n: int) -> str:
    return f"{rng.randrange(10**n):0{n}d}"


def _card(rng: Random, n: int, right: bool = True) -> str:
    """n digits with a card's checksum, or with a wrong one."""
    head = _digits(rng, n - 1)
    return head + rng.choice([d for d in "0123456789" if luhn(head + d) == right])


def _grouped(rng: Random, digits: str) -> str:
    """Digits in fours, or in 4, 6 and the rest, or together."""
    by = rng.choice(("", " ", "-", ".", "/", "  ", " - "))
    cuts = rng.choice(((4, 8, 12, 16), (4, 8, 12, 16), (4, 8, 12, 16), (4, 10)))
    parts = [digits[a:b] for a, b in zip((0, *cuts), (*cuts, len(digits)), strict=True) if digits[a:b]]
    return by.join(parts) if rng.randrange(3) else digits


def _span(rng: Random, kind: str) -> str:
    """A text of the kind, in a plain form or one that patterns for plain forms miss."""
    pick = lambda *of: rng.choice(of)
    d = lambda n: _digits(rng, n)
    if kind == "email":
        name = _word(rng) + pick("", "." + _word(rng), d(2), "_" + _word(rng, 1, 4), "." + d(2))
        name = name.capitalize() if rng.random() < 0.1 else name
        place = _word(rng, 3, 9) + pick("", d(1), "-" + _word(rng, 2, 6))
        end = pick("com", "org", "net", "de", "fr", "es", "io", "example.com", "co.uk", _word(rng, 2, 4))
        if rng.random() < 0.1:
            return f"{name}{pick(' at ', ' AT ')}{place}{pick(' dot ', ' DOT ')}{end}"
        dot = pick(".", ".", ".", " [dot] ", " (dot) ", "[dot]", "(dot)", " {dot} ", " [DOT] ")
        return name + pick("@", "@", "@", " [at] ", "[at]", " (at) ", "(at)", " {at} ", " @ ", " [AT] ", "(AT)") + place + dot + end
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        return _grouped(rng, _card(rng, pick(14, 15, 16, 16, 16, 16, 19)))
    by = pick(" ", " ", "-", ".")
    a, b, c = d(3), d(3), d(4)
    plain = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}){b}-{c}", f"{a}/{b}-{c}", f"1-{a}-{b}-{c}")
    national = pick(f"0{d(1)}{by}{d(2)}{by}{d(2)}{by}{d(2)}{by}{d(2)}", f"0{d(2)}{by}{d(4)}{by}{d(4)}", f"0{d(4)}{by}{d(3)}{by}{d(3)}", f"(0{d(pick(2, 3))}) {d(4)} {d(4)}", f"0{d(3)}/{d(3)}{by}{d(4)}", f"{d(3)} {d(2)} {d(2)} {d(3)}")
    return pick(plain, plain, national, national, f"+{rng.randrange(1, 99)} {plain}", f"+{d(2)}{d(9)}", f"00{rng.randrange(1, 99)} {plain}", f"00{d(2)} {d(2)} {d(4)} {d(4)}")


#: Words that often stand before each kind, and before digits that aren't personal data.
BEFORE = {
    "email": ("mail", "email", "e-mail:", "write to", "contact", "correo", "courriel", "an", "or", "<"),
    "ip": ("ip", "host", "server", "from", "address", "at", "login from"),
    "card": ("card", "visa", "card no.", "tarjeta", "carte", "paid with", "Karte", "number:"),
    "phone": ("call", "phone", "tel.", "tel:", "Telefon", "mobile", "fax", "llame al", "appelez le", "dial", "or"),
}
BEFORE_DECOYS = ("version", "order", "isbn", "page", "room", "section", "no.", "token =", "in", "id", "total", "chapter", "ref", "build", "lines")


def _decoy(rng: Random) -> str:
    """Text with digits or marks that is not personal data."""
    pick = lambda *of: rng.choice(of)
    d = lambda n: _digits(rng, n)
    hexed = "".join(rng.choices("0123456789abcdef", k=rng.randrange(8, 41)))
    if rng.random() < 0.25:
        # What is nearest to personal data: wrong checksums, long numbers, rows of numbers, wrong parts of an address.
        wrong = _card(rng, pick(14, 15, 16, 16, 16, 19), False)
        row = " ".join(d(rng.randrange(1, 4)) for _ in range(rng.randrange(7, 14)))
        at = f"{_running(rng)} at {_running(rng)}" + pick("", ".", ". " + _running(rng).capitalize())
        large = pick(".", "-", ":").join(str(rng.randrange(256, 1000)) for _ in range(4))
        return pick(wrong, wrong, _grouped(rng, wrong), _grouped(rng, wrong), d(rng.randrange(9, 14)), d(rng.randrange(20, 40)), row, large, f"{_word(rng)}@{_word(rng)}", f"{_word(rng)} @ {_word(rng)}", f"{_word(rng)}.{_word(rng)}", at, at, at)
    return pick(
        f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(2)}", f"Version {d(1)}.{d(1)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"${d(2)},{d(3)}.{d(2)}", d(rng.randrange(1, 9)), hexed, f'"{hexed}"', f'token = "{hexed}"', f"{d(2)}%", f"No. {d(4)}",
        f"{d(3)} x {d(3)}", "@" + _word(rng), f"{d(4)}/{d(2)}", f"({d(4)})", f"[{d(1)}]", f"{_word(rng)}{d(2)}", f"{d(5)}-{d(4)}", f"{d(1)}-{d(3)}", f"97{d(1)}-{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(1)},{d(3)},{d(3)}",
        f"{d(2)} {d(2)} {d(2)}", f"{d(4)} {d(4)}", f"{d(2)}.{d(5)}, -{d(2)}.{d(5)}", f"20{d(2)}-1{d(1)}-0{d(1)} 0{d(1)}:{d(2)}:{d(2)}", f"{_word(rng)} at {_word(rng)}", f"({_word(rng)})", f"{d(12)}.{d(3)}", f"#{d(10)}", f"{_word(rng)}_{d(8)}", f"{d(1)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(3)},{d(2)}", f"0x{hexed}",
    )


def examples(rng: Random, n: int, length: int) -> tuple[list[str], np.ndarray]:
    """Texts of a length and their tags: invented words with labelled spans and decoys between."""
    texts, tags = [], np.zeros((n, length), np.int64)
    for row in range(n):
        text, mine = "", []
        shout, trail = rng.random() < 0.1, rng.choice(("", "", "", ".", ",", ";", "!!", "###", "%%%", "$$$", "***"))
        while len(text) < length + 40:
            draw = rng.random()
            piece = _decoy(rng) if draw < 0.2 else _running(rng)
            if draw < 0.07:
                text += rng.choice(BEFORE_DECOYS) + " "
            if draw > 0.88:
                kind = rng.randrange(len(KINDS))
                piece = _span(rng, KINDS[kind])
                if draw > 0.94:
                    text += rng.choice(BEFORE[KINDS[kind]]) + " "
                mine.append((len(text), len(text) + len(piece), kind))
                if rng.random() < 0.15:
                    piece += rng.choice((" ", "  ", "\n")) + _digits(rng, rng.randrange(1, 14))
            elif shout:
                piece = piece.upper()
            elif rng.random() < 0.1:
                piece = piece.capitalize()
            text += piece + (trail if rng.random() < 0.7 else "") + rng.choice((" ", " ", " ", "\n", ", "))
        at = rng.randrange(len(text) - length + 1)
        for a, b, kind in mine:
            a, b = max(a - at, 0), min(b - at, length)
            if a < b:
                tags[row, a] = 1 + 2 * kind
                tags[row, a + 1 : b] = 2 + 2 * kind
        texts.append(text[at : at + length])
    return texts, tags


def train(steps: int = 4000, batch: int = 24, length: int = 64, width: int = 12, hidden: int = 28, rate: float = 0.015, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters trained by Adam on invented labelled spans: the same each time on the same numpy."""
    rng = Random(seed)
    p = {k: v.astype(np.float32) for k, v in initial(width, hidden, seed).items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        texts, y = examples(rng, batch, length)
        _, grads = loss_and_grads(p, np.stack([symbols(t) for t in texts]), y)
        norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
        now = float(rate * min(1, 5 / norm) if norm > 5 else rate)
        now *= 0.5 * (1 + np.cos(np.pi * step / (steps + 1)))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.98 * second[k] + 0.02 * g**2
            p[k] = (p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-8)).astype(np.float32)
    return p


#: The parameters that train() has made, some 40 KB. `python -m lodestone.llm.sequence_tagger` makes them anew.
STORED = Path(__file__).with_name("sequence_tagger.npz")


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    """The stored parameters, so that no process trains before it starts."""
    with np.load(STORED) as found:
        return {k: found[k] for k in found.files}


if __name__ == "__main__":
    np.savez_compressed(STORED, **train())
