"""Text runs with styles, and lists by level: what word processors have instead of a tree."""

from __future__ import annotations

from leafmill.functions.tree import Builder

#: Nesting order of styles, outermost first.
ORDER = ["strong", "emphasis", "strikethrough", "superscript", "subscript", "small_caps", "underline"]


class Runs:
    """Keeps the common outer styles of neighbouring runs open."""

    def __init__(self, out: Builder):
        self.out, self.open = out, []

    def style(self, styles: set[str]) -> None:
        want = [s for s in ORDER if s in styles]
        same = 0
        while same < min(len(want), len(self.open)) and want[same] == self.open[same]:
            same += 1
        while len(self.open) > same:
            self.out.end()
            self.open.pop()
        for s in want[same:]:
            self.out.begin(s)
            self.open.append(s)

    def text(self, s: str, styles: set[str]) -> None:
        if s:
            self.style(styles)
            self.out.text(s)

    def code(self, s: str, styles: set[str]) -> None:
        if s:
            self.style(styles)
            kids = self.out.spans[-1].kids
            if kids and kids[-1].tag == "code":
                kids[-1].text += s
            else:
                self.out.inline("code", text=s)

    def end(self) -> None:
        self.style(set())


class Lists:
    """Opens and closes list levels as paragraphs come; a paragraph without a level ends all."""

    def __init__(self, out: Builder, most: int = 64):
        self.out, self.levels, self.most = out, [], most

    def item(self, level: int, key: object, ordered: bool, start: int = 1, style: str = "decimal", delimiter: str = "period") -> None:
        """Begin an item at a level (from 0); another key is another list."""
        level = min(max(level, 0), self.most - 1)
        while self.levels and (len(self.levels) - 1 > level or (len(self.levels) - 1 == level and self.levels[-1] != (key, ordered))):
            self._close()
        if len(self.levels) - 1 == level:
            self.out.close("list_item")
        else:
            while len(self.levels) - 1 < level:  # skipped levels get an empty item
                self.out.open("list", kind="ordered" if ordered else "unordered", start=start if len(self.levels) == level else 1, style=style, delimiter=delimiter)
                self.levels.append((key, ordered))
                if len(self.levels) - 1 < level:
                    self.out.open("list_item")
        self.out.open("list_item")

    def _close(self) -> None:
        self.out.close("list_item")
        self.out.close("list")
        self.levels.pop()

    def end(self) -> None:
        while self.levels:
            self._close()
