"""Compound binary files: named streams over chains of sectors."""

from __future__ import annotations

import struct

from leafmill.functions.tree import Refused

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_LAST = 0xFFFFFFF0  # numbers from here on are no sectors


class Compound:
    def __init__(self, data: bytes, code: str):
        if len(data) < 512 or data[:8] != MAGIC:
            raise Refused(f"{code}.not-a-compound-file")
        self.data, self.code = data, code
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise Refused(f"{code}.malformed-container")
        self.size, self.mini_size = 1 << shift, 64
        root, = struct.unpack_from("<I", data, 48)
        self.cutoff, mini_fat, n_mini, difat, n_difat = struct.unpack_from("<IIIII", data, 56)
        sectors = list(struct.unpack_from("<109I", data, 76))
        seen = 0
        while difat < _LAST and seen <= n_difat:
            part = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            sectors += part[:-1]
            difat = part[-1]
            seen += 1
        self.fat: list[int] = []
        for s in sectors:
            if s < _LAST:
                self.fat += struct.unpack(f"<{self.size // 4}I", self._sector(s))
        directory = self._chain(root)
        self.mini_fat = []
        if n_mini:
            raw = self._chain(mini_fat)
            self.mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
        self.entries: dict[str, tuple[int, int]] = {}
        self.mini = b""
        for i in range(0, len(directory) - 127, 128):
            n, kind = struct.unpack_from("<HB", directory, i + 64)
            start, size = struct.unpack_from("<IQ", directory, i + 116)
            if self.size == 512:
                size &= 0xFFFFFFFF
            name = directory[i : i + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                self.mini = self._chain(start)[:size]
            elif kind == 2:
                self.entries.setdefault(name, (start, size))

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        out = self.data[at : at + self.size]
        if len(out) < self.size:
            if not out:
                raise Refused(f"{self.code}.truncated")
            out += bytes(self.size - len(out))
        return out

    def _chain(self, start: int) -> bytes:
        out, n, seen = [], start, 0
        while n < _LAST:
            if n >= len(self.fat) and self.fat:
                raise Refused(f"{self.code}.malformed-container")
            out.append(self._sector(n))
            n = self.fat[n]
            seen += 1
            if seen > len(self.fat):
                raise Refused(f"{self.code}.malformed-container")
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        found = self.entries.get(name)
        if found is None:
            return None
        start, size = found
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, n, seen = [], start, 0
        while n < _LAST and seen * 64 < size:
            out.append(self.mini[n * 64 : n * 64 + 64])
            n = self.mini_fat[n] if n < len(self.mini_fat) else _LAST
            seen += 1
        return b"".join(out)[:size]
