"""The most similar dictionary key of many texts at once, with NumPy inside a task.

The keys are few (a size-checked dictionary); texts come in batches.  Bounds that every accepted pair meets are computed for
all pairs of a batch together, and ``weighted_ratio`` is called only for the few pairs that pass.  The bounds follow from the
threshold, so the result is that of comparing every pair.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sofralytics.functions.similarity import sorted_words, weighted_ratio

LONGEST_KEY = 64  # the bits of a machine word
MOST_KEYS, MOST_CELLS = 5_000, 1_000_000  # keys, and keys times different characters
THRESHOLDS = (85.0, 90.0)  # within these, lengths 1.5 times apart matter by containment, a common word or a near window only
CONTAINED = 90.0  # the weighted ratio of a text and a key inside it (or around it), with lengths 1.5 to 8 times apart
COMMON_WORD = 0.95 * 0.9 * 100.0  # the same where only the sorted words contain each other or a word is in common
SLACK = 1e-6
ROWS = 4096  # texts of one length whose tables stay in a core's cache
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _distinct_words(text: str) -> str:
    return " ".join(sorted(set(text.split())))


def _apart(a, b):
    """Whether the second length is at least 1.5 and at most 8 times the first."""
    return (b * 2 >= a * 3) & (b <= a * 8)


def _expanded(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries ``of`` of a list of lists with these starts: (place in ``of``, index of the member), one for each member."""
    sizes = starts[of + 1] - starts[of]
    place = np.repeat(np.arange(len(of)), sizes)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of][place]


def _stretches(codes: np.ndarray, longest: int):
    """(length, hashes of all stretches of this length) of rows of codes, for growing lengths."""
    wide = codes.astype(np.uint64)
    hashes = wide
    for n in range(1, min(longest, codes.shape[1]) + 1):
        if n > 1:
            hashes = hashes[:, :-1] * _BASE + wide[:, n - 1 :]
        yield n, hashes


class _Patterns:
    """Strings of one length, met by hash."""

    def __init__(self, found: dict[int, list[int]]):
        self.hashes = np.array(sorted(found), dtype=np.uint64)
        self.starts = np.cumsum([0] + [len(found[int(h)]) for h in self.hashes])
        self.members = np.array([k for h in self.hashes for k in found[int(h)]], dtype=np.int64)
        self.known = np.zeros(1 << 16, dtype=bool)
        self.known[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * _MIX) >> np.uint64(48)

    def met(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, member, start) of all stretches that are a pattern."""
        flat = np.flatnonzero(self.known[self._slot(hashes)])
        values = hashes.ravel()[flat]
        at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
        same = self.hashes[at] == values
        place, member = _expanded(self.starts, at[same])
        row, start = np.divmod(flat[same], hashes.shape[1])
        return row[place], self.members[member], start[place]


class KeyIndex:
    """Keys in their order; of equally similar ones the first is taken."""

    @staticmethod
    def takes(keys: list[str], threshold: float) -> bool:
        within = THRESHOLDS[0] <= threshold <= THRESHOLDS[1] and 0 < len(keys) <= MOST_KEYS and max(map(len, keys)) <= LONGEST_KEY
        return within and len(keys) * len(set("".join(keys))) <= MOST_CELLS

    def __init__(self, keys: list[str], threshold: float):
        self.keys, self.threshold, self.none = keys, threshold, len(keys)
        self.lengths = np.array([len(k) for k in keys], dtype=np.int64)
        self.shortest, self.longest = int(self.lengths.min()), int(self.lengths.max())
        chars = sorted({c for k in keys for c in k})
        self.code_of = np.zeros(0x110000, dtype=np.int32)  # 0: in no key
        self.code_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.codes = len(chars) + 1
        self._index_bags(keys)
        self._index_masks(keys)
        self._index_words(keys)
        self.inside = self._patterns({k: [i] for i, k in enumerate(keys)})
        resorted: dict[str, list[int]] = {}
        for i, k in enumerate(keys):
            if " " in k:
                resorted.setdefault(sorted_words(k), []).append(i)
        self.inside_sorted = self._patterns(resorted)
        self.around = self._parts({k: [i] for i, k in enumerate(keys)})
        self.around_sorted = self._parts(resorted)
        self._index_windows(keys)

    def encode(self, texts: list[str]) -> np.ndarray:
        return self.code_of[np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)]

    def _patterns(self, strings: dict[str, list[int]]) -> dict[int, _Patterns]:
        by_length: dict[int, dict[int, list[int]]] = {}
        for s, members in strings.items():
            *_, (n, hashes) = _stretches(self.encode([s])[None, :], len(s))
            by_length.setdefault(n, {}).setdefault(int(hashes[0, 0]), []).extend(members)
        return {n: _Patterns(found) for n, found in by_length.items()}

    def _parts(self, strings: dict[str, list[int]]) -> dict[str, int]:
        """The first key of which a string is a stretch that is 1.5 to 8 times shorter."""
        first: dict[str, int] = {}
        for s, members in strings.items():
            for n in range(1, len(s)):
                if _apart(n, len(s)):
                    for i in range(len(s) - n + 1):
                        part = s[i : i + n]
                        first[part] = min(first.get(part, self.none), *members)
        return first

    def _index_bags(self, keys: list[str]) -> None:
        """The characters of each key, repeats numbered, as columns; keys that repeat a word have a second column without."""
        forms = [(k, i) for i, k in enumerate(keys)] + [(_distinct_words(k), i) for i, k in enumerate(keys) if len(_distinct_words(k)) < len(k)]
        forms.sort(key=lambda f: len(f[0]))
        self.form_key = np.array([i for _, i in forms], dtype=np.int64)
        self.form_length = np.array([len(s) for s, _ in forms], dtype=np.int64)
        self.form_whole = np.array([len(s) == len(keys[i]) for s, i in forms])
        features: dict[tuple[str, int], int] = {}
        entries = [(features.setdefault((c, t), len(features)), col) for col, (s, _) in enumerate(forms) for c, n in Counter(s).items() for t in range(1, n + 1)]
        self.bags = np.zeros((len(features), len(forms)), dtype=np.float32)
        rows, columns = zip(*entries)
        self.bags[rows, columns] = 1.0
        self.feature_code = np.array([int(self.code_of[ord(c)]) for c, _ in features], dtype=np.int64)
        self.feature_times = np.array([t for _, t in features], dtype=np.int32)

    def _index_masks(self, keys: list[str]) -> None:
        """For each key and code the places of the code in the key, as bits; of the key as it is and of its sorted words."""
        self.masks, self.masks_sorted = (np.zeros((len(keys), self.codes), dtype=np.uint64) for _ in range(2))
        for masks, form in ((self.masks, str), (self.masks_sorted, sorted_words)):
            for i, k in enumerate(keys):
                for at, code in enumerate(self.encode([form(k)])):
                    masks[i, code] |= np.uint64(1 << at)
        self.full = np.array([(1 << len(k)) - 1 for k in keys], dtype=np.uint64)

    def _index_words(self, keys: list[str]) -> None:
        holders: dict[str, list[int]] = {}
        for i, k in enumerate(keys):
            for w in sorted(set(k.split())):
                holders.setdefault(w, []).append(i)
        self.words = pa.array(list(holders), pa.string())
        self.word_length = np.array([len(w) for w in holders], dtype=np.int64)
        self.word_starts = np.cumsum([0] + [len(h) for h in holders.values()])
        self.word_keys = np.array([i for h in holders.values() for i in h], dtype=np.int64)
        self.plural = np.array([" " in k for k in keys])
        self.distinct_length = np.array([len(_distinct_words(k)) for k in keys], dtype=np.int64)
        # The first key with a word and a length 1.5 to 8 times apart, for each word and length of a text.
        self.first_apart = np.full((len(holders), 8 * self.longest + 1), self.none, dtype=np.int32)
        sizes = np.arange(8 * self.longest + 1)
        for w, held in enumerate(holders.values()):
            for i in reversed(held):
                self.first_apart[w, _apart(self.lengths[i], sizes) | ((sizes > 0) & _apart(sizes, self.lengths[i]))] = i

    def _index_windows(self, keys: list[str]) -> None:
        """Fewest characters that a shorter text of each length shares in order with a longer one for a near window, and the
        length of a stretch that both then have whole: c common characters with d others fall into d + 1 pieces at most.
        """
        window = self.threshold / 0.9 - SLACK
        self.window_common, self.piece = np.full(self.longest + 1, self.longest * 8 + 1), self.longest
        self.window_spare = np.zeros(self.longest + 1, dtype=np.int64)
        for m in range(1, self.longest + 1):
            near = [(c, s) for s in range(1, m + 1) if (c := math.ceil((m + s) * window / 200.0)) <= s and (c, s) != (m, m)]
            if near:
                self.window_common[m] = min(c for c, _ in near)
                self.window_spare[m] = max(m + s - 2 * c for c, s in near)
                self.piece = min(self.piece, min(math.ceil(c / (m + s - 2 * c + 1)) for c, s in near))
        self.least_window = next((m for m in range(1, self.longest + 1) if self.window_common[m] <= m), self.longest + 1)
        grams: dict[str, list[int]] = {}  # members are a key and a place in it as one number
        for i, k in enumerate(keys):
            if len(k) >= self.least_window:
                for j in range(len(k) - self.piece + 1):
                    grams.setdefault(k[j : j + self.piece], []).append(i * LONGEST_KEY + j)
        self.grams = self._patterns(grams).get(self.piece)

    def _in_order(self, masks: np.ndarray, codes: np.ndarray, rows: np.ndarray, keys: np.ndarray, start=0, width=None, bits=None) -> np.ndarray:
        """Length of the longest common subsequence of texts and keys, one machine word a pair.

        With ``start`` and ``width`` of that stretch of the text, with ``bits`` of these places of the key.
        """
        state = np.full(len(rows), ~np.uint64(0))
        flat_masks, first, length = masks.ravel(), keys * self.codes, codes.shape[1]
        flat = np.append(codes.ravel(), 0)
        for j in range(length if width is None else int(width.max(initial=0))):
            if width is None:
                code = flat[rows * length + j]
            else:
                at = start + j
                code = flat[np.where((j < width) & (at >= 0) & (at < length), rows * length + at, len(flat) - 1)]
            hit = state & flat_masks[first + code]
            if bits is not None:
                hit &= bits
            state = (state + hit) | (state - hit)
        return self.lengths[keys] - np.bitwise_count(state & self.full[keys]).astype(np.int64)

    def _alike(self, codes: np.ndarray, floor: float, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, form of a key, characters in common) where their count allows the ratio: ``floor``, or ``low`` if not whole."""
        n, length = codes.shape
        joint = self.form_length + length
        bound = np.where(self.form_whole, floor, low)
        needed = np.ceil(joint * (bound / 200.0) - SLACK)
        chosen = np.flatnonzero(needed <= np.minimum(self.form_length, length))
        if not len(chosen) or not n:
            return (np.zeros(0, dtype=np.int64),) * 3
        chosen = slice(chosen[0], chosen[-1] + 1)
        flat = (np.arange(n)[:, None] * self.codes + codes).ravel()
        counts = np.bincount(flat, minlength=n * self.codes).reshape(n, self.codes)
        held = (counts[:, self.feature_code] >= self.feature_times).astype(np.float32)
        common = held @ self.bags[:, chosen]
        rows, columns = np.nonzero(common >= needed[chosen].astype(np.float32))
        return rows, columns + chosen.start, common[rows, columns].astype(np.int64)

    def _contained(self, texts: list[str], codes: np.ndarray, patterns: dict[int, _Patterns], parts: dict[str, int]) -> np.ndarray:
        """For each text the first key inside or around it with lengths 1.5 to 8 times apart."""
        first = np.full(len(texts), self.none)
        if _apart(codes.shape[1], self.longest) or codes.shape[1] * 8 < self.longest:
            first[:] = [parts.get(t, self.none) for t in texts]
        for n, hashes in _stretches(codes, codes.shape[1] * 2 // 3):
            if n in patterns and _apart(n, codes.shape[1]):
                np.minimum.at(first, *patterns[n].met(hashes)[:2])
        return first

    def _checked(self, first: np.ndarray, texts: list[str], form) -> np.ndarray:
        """Hashes may collide: a key that is not there is looked for again among all keys."""
        for at in np.flatnonzero(first < self.none):
            t, k = form(texts[at]), form(self.keys[first[at]])
            if t not in k and k not in t:
                sizes = [(form(k), *sorted((len(k), len(t)))) for k in self.keys]
                first[at] = next((i for i, (k, a, b) in enumerate(sizes) if _apart(a, b) and (k in t or t in k)), self.none)
        return first

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the most similar key, weighted ratio) of each distinct text; the number of keys and 0 below the threshold."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        best_key, best_score = np.full(len(texts), self.none), np.zeros(len(texts))
        order = np.argsort(sizes, kind="stable")
        order = order[(sizes[order] * 8 >= self.shortest) & (sizes[order] <= self.longest * 8) & (sizes[order] > 0)]
        if not len(order):
            return best_key, best_score
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        groups = [group[i : i + ROWS] for group in np.split(order, cuts) for i in range(0, len(group), ROWS)]
        for group in groups:
            best_key[group], best_score[group] = self._best_of_length([texts[i] for i in group], int(sizes[group[0]]))
        return best_key, best_score

    def _best_of_length(self, texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        codes = self.encode(texts).reshape(len(texts), length)
        first = self._checked(self._contained(texts, codes, self.inside, self.around), texts, str)
        score = np.where(first < self.none, CONTAINED, 0.0)
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        word_row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        everything = split.flatten().dictionary_encode()
        # Each word once a text.
        own = np.unique(word_row * (len(everything.dictionary) + 1) + everything.indices.to_numpy())
        row, word = own // (len(everything.dictionary) + 1), own % (len(everything.dictionary) + 1)
        repeats = np.bincount(word_row, minlength=len(texts)) > np.bincount(row, minlength=len(texts))
        spaced = np.bincount(word_row, minlength=len(texts)) > 1
        in_keys = pc.index_in(everything.dictionary, value_set=self.words).fill_null(-1).to_numpy()[word]
        row, word = row[in_keys >= 0], in_keys[in_keys >= 0]

        free = first == self.none
        if COMMON_WORD >= self.threshold:
            usable = free[row]
            np.minimum.at(first, row[usable], self.first_apart[word[usable], length])
            rest = np.flatnonzero(free & spaced)
            if len(rest):
                again = [sorted_words(texts[i]) for i in rest]
                of_sorted = self._contained(again, self.encode(again).reshape(len(rest), length), self.inside_sorted, self.around_sorted)
                first[rest] = np.minimum(first[rest], self._checked(of_sorted, again, sorted_words))
            score = np.where(free & (first < self.none), COMMON_WORD, score)

        shared, heavy = self._sharing(texts, row, word, repeats, length, free)
        pairs = [self._windows(codes, np.flatnonzero(free), length, score), (shared[heavy] // self.none, shared[heavy] % self.none)]
        for some, floor in ((free, self.threshold), (~free, CONTAINED)):
            rows = np.flatnonzero(some)
            pairs.append(self._near(texts, codes, rows, spaced, shared, length, floor))
            rows = np.flatnonzero(some & repeats)
            pairs.append(self._near_without_repeats(texts, rows, floor))
        code = np.unique(np.concatenate([r * self.none + k for r, k in pairs]))
        for r, k in zip((code // self.none).tolist(), (code % self.none).tolist()):
            value = weighted_ratio(texts[r], self.keys[k], self.threshold - SLACK)
            if value >= self.threshold and (value, -k) > (score[r], -first[r]):
                first[r], score[r] = k, value
        return first, score

    def _near(self, texts: list[str], codes: np.ndarray, rows: np.ndarray, spaced: np.ndarray, shared: np.ndarray, length: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of similar lengths whose plain or sorted ratio may reach the floor, or that of their words with shared ones first."""
        low = floor / 0.95 - SLACK
        at, form, common = self._alike(codes[rows], floor, low)
        key, joint = self.form_key[form], self.form_length[form] + length
        keep = ~self.form_whole[form]
        plain = np.flatnonzero(self.form_whole[form])
        ratio = 200.0 * self._in_order(self.masks, codes[rows], at[plain], key[plain]) / joint[plain]
        keep[plain] = ratio >= floor - SLACK
        # The same characters with the words in another order, so only where either has several.
        other = plain[~keep[plain] & (200.0 * common[plain] >= low * joint[plain]) & (spaced[rows][at[plain]] | self.plural[key[plain]])]
        if len(other):
            keep[other] = np.isin(rows[at[other]] * self.none + key[other], shared)
            other = other[~keep[other]]
        if len(other):
            chosen, back = np.unique(at[other], return_inverse=True)
            again = self.encode([sorted_words(texts[rows[i]]) for i in chosen]).reshape(len(chosen), length)
            keep[other] = 200.0 * self._in_order(self.masks_sorted, again, back, key[other]) >= low * joint[other]
        return rows[at[keep]], key[keep]

    def _near_without_repeats(self, texts: list[str], rows: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that repeat a word, by their distinct words."""
        low = floor / 0.95 - SLACK
        shorter = [_distinct_words(texts[i]) for i in rows]
        found = [(np.zeros(0, dtype=np.int64),) * 2]
        for n in sorted({len(s) for s in shorter}):
            some = np.array([i for i, s in enumerate(shorter) if len(s) == n])
            at, form, _ = self._alike(self.encode([shorter[i] for i in some]).reshape(len(some), n), low, low)
            found.append((rows[some[at]], self.form_key[form]))
        return tuple(np.concatenate(part) for part in zip(*found))

    def _sharing(self, texts: list[str], row: np.ndarray, word: np.ndarray, repeats: np.ndarray, length: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of similar lengths with words in common, as numbers in order, and which of them these words alone may lift
        to the floor, since they weigh much against the distinct words of either.
        """
        place, member = _expanded(self.word_starts, word)
        key = self.word_keys[member]
        short, long = np.minimum(self.lengths[key], length), np.maximum(self.lengths[key], length)
        close = long * 2 < short * 3
        code, back = np.unique((row[place] * self.none + key)[close], return_inverse=True)
        shared = np.bincount(back, weights=self.word_length[word[place[close]]] + 1.0, minlength=len(code)) - 1
        own = np.full(len(texts), length)
        for i in np.flatnonzero(repeats):
            own[i] = len(_distinct_words(texts[i]))
        at = code // self.none
        least = np.minimum(own[at], self.distinct_length[code % self.none])
        low = np.where(free[at], self.threshold, CONTAINED) / 0.95 - SLACK
        return code, 200.0 * shared >= low * (shared + least)

    def _windows(self, codes: np.ndarray, rows: np.ndarray, length: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs with lengths apart that share a stretch, and around it enough characters in order for a near window."""
        if self.grams is None or length < self.least_window or not len(rows):
            return (np.zeros(0, dtype=np.int64),) * 2
        for n, hashes in _stretches(codes[rows], self.piece):
            if n == self.piece:
                at, member, start = self.grams.met(hashes)
        key, place = np.divmod(member, LONGEST_KEY)
        apart = _apart(np.minimum(self.lengths[key], length), np.maximum(self.lengths[key], length))
        # How far the text's stretch lies behind the key's, once for each pair and distance.
        shift = (start - place + LONGEST_KEY)[apart]
        code = np.unique((at[apart] * self.none + key[apart]) * (9 * LONGEST_KEY) + shift)
        code, shift = np.divmod(code, 9 * LONGEST_KEY)
        (at, key), shift = np.divmod(code, self.none), shift - LONGEST_KEY
        short = np.minimum(self.lengths[key], length)
        spare = self.window_spare[short]
        within = np.flatnonzero(self.lengths[key] < length)  # the key lies in the text
        around = np.flatnonzero(self.lengths[key] > length)
        common = np.zeros(len(at), dtype=np.int64)
        common[within] = self._in_order(self.masks, codes[rows], at[within], key[within], (shift - spare)[within], (short + 2 * spare)[within])
        low, high = np.maximum(-shift - spare, 0)[around], np.minimum(length - shift + spare, self.lengths[key])[around]
        bits = (~np.uint64(0) << low.astype(np.uint64)) & (~np.uint64(0) >> (64 - high).astype(np.uint64))
        common[around] = self._in_order(self.masks, codes[rows], at[around], key[around], bits=bits)
        # At best the stretch holds no more than the common characters.
        keep = np.flatnonzero((common >= self.window_common[short]) & (0.9 * 200.0 * common >= (short + common) * (score[rows[at]] - SLACK)))
        return rows[at[keep]], key[keep]
