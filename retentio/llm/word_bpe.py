"""The word tokenizer's rules: how a text falls into chunks and pre-tokens, and
which merges join the bytes of a pre-token.

White space separates pre-tokens and normalisation works within them, so the
tokens of a text are those of its white-space-separated chunks, one after the
other.  Special strings contain no white space either; as by the library's
default each of them is one token.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

#: Unicode's White_Space characters; ``str.split`` also splits at \\x1c-\\x1f
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the
    next free one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def splitter():
    """text -> chunks."""
    odd, white = re.compile("[\x1c-\x1f]"), re.compile(f"[{WHITE}]+")

    def chunks(text: str) -> list[str]:
        if odd.search(text):
            return [c for c in white.split(text) if c]
        return text.split()

    return chunks


class WordBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], spec["model"]["vocab"]
        self.end = model["end_of_word_suffix"]
        self.vocab = ids
        self.alphabet = byte_alphabet()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.inner = [ids[c] for c in self.alphabet]
        self.last = [ids[c + self.end] for c in self.alphabet]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pretokens = regex.compile(split["pattern"]["Regex"]).findall
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.special_mark = "<|"

    @staticmethod
    def normal(part: str) -> str:
        """NFC and lower case, each character for itself."""
        if part.isascii():
            return part.lower()
        part = unicodedata.normalize("NFC", part)
        return "".join(c.lower() for c in part) if "Σ" in part else part.lower()

    def merged(self, pretoken: str) -> list[int]:
        """The token ids of one pre-token: the lowest-ranked pair first, the leftmost of equals."""
        data = pretoken.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data[:-1]]
        ids.append(self.last[data[-1]])
        return self._short(ids) if len(ids) < 100 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        merges = self.merges
        while len(ids) > 1:
            best, at = None, -1
            for i, pair in enumerate(zip(ids, ids[1:])):
                m = merges.get(pair)
                if m is not None and (best is None or m < best):
                    best, at = m, i
            if best is None:
                break
            ids[at:at + 2] = [best[1]]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        right, left = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n and (m := merges.get((ids[k], ids[right[k]]))):
                    heapq.heappush(heap, (m[0], k, m[1], ids[k], ids[right[k]]))
        return [x for x in ids if x >= 0]

    def whole_tokens(self) -> frozenset[str]:
        """The pre-tokens proven to be one token: each vocabulary string that
        can end a word is merged from its bytes, and stays if one token is left."""
        byte_of = {c: b for b, c in enumerate(self.alphabet)}
        proven = set()
        for token, id_ in self.vocab.items():
            if token.endswith(self.end):
                try:
                    word = bytes(byte_of[c] for c in token[:-len(self.end)]).decode()
                except UnicodeDecodeError:  # part of a character: no pre-token
                    continue
                if word and self.merged(word) == [id_]:
                    proven.add(word)
        return frozenset(proven)
