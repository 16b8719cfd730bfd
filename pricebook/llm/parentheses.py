"""A tree as balanced parentheses: packed bits, and per block the least excess at a tree of ranges above the blocks."""

import numpy as np

BLOCK = 64                  # parentheses in a block


class Parentheses:
    """``(`` is 1, ``)`` is 0; nodes are numbered by their opening parenthesis, in preorder."""

    def __init__(self, packed, n):
        self.packed, self.n = packed, n
        bits = np.unpackbits(packed, count=n)
        self.opens = np.flatnonzero(bits)
        self.excess = np.cumsum(bits.astype(np.int32) * 2 - 1, dtype=np.int32)
        blocks = max(1, -(-n // BLOCK))
        width = 1 << (blocks - 1).bit_length()
        least = np.full(2 * width, np.iinfo(np.int32).max, np.int32)     # a heap: node i covers 2 i and 2 i + 1
        if n:
            least[width:width + blocks] = np.minimum.reduceat(self.excess, np.arange(0, n, BLOCK))
        for level in range(width.bit_length() - 1, 0, -1):
            a = 1 << (level - 1)
            least[a:2 * a] = np.minimum(least[2 * a:4 * a:2], least[2 * a + 1:4 * a:2])
        self.least, self.width = least, width
        pairs = np.zeros(n, bool)
        pairs[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.pairs = np.concatenate([[0], np.cumsum(pairs, dtype=np.int64)])

    @classmethod
    def of_steps(cls, closes, opens):
        """From the parentheses closed and then opened before each next leaf; what is open is closed at the end."""
        open_left = int(opens.sum() - closes.sum())
        bits = np.repeat(np.tile(np.array([0, 1], np.uint8), len(opens)), np.column_stack([closes, opens]).ravel())
        bits = np.concatenate([bits, np.zeros(open_left, np.uint8)])
        return cls(np.packbits(bits), len(bits))

    def _in_block(self, i, goal, block, out, todo):
        """Look for the goal in one block of each query, from a place on."""
        at = np.maximum(i + 1, block * BLOCK)
        end = np.minimum((block + 1) * BLOCK, self.n)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.excess[at[live]] == goal[live]
            out[todo[live[hit]]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]

    def findclose(self, i):
        """Places of the closing parentheses that belong to the opening ones at places i."""
        i = np.asarray(i, np.int64)
        out = np.full(len(i), -1, np.int64)
        todo, goal = np.arange(len(i)), self.excess[i] - 1
        self._in_block(i, goal, i // BLOCK, out, todo)
        todo = np.flatnonzero(out < 0)
        i, goal = i[todo], goal[todo]
        node = i // BLOCK + self.width
        up = np.ones(len(i), bool)
        while up.any():                                         # up to the first range on the right that goes as low
            k = np.flatnonzero(up)
            right = (node[k] & 1) == 0
            fits = right & (self.least[node[k] | 1] <= goal[k])
            node[k] = np.where(fits, node[k] | 1, node[k] >> 1)
            up[k[fits]] = False
        down = node < self.width
        while down.any():                                       # down to its first block that does
            k = np.flatnonzero(down)
            left = 2 * node[k]
            node[k] = np.where(self.least[left] <= goal[k], left, left + 1)
            down = node < self.width
        self._in_block(i, goal, node - self.width, out, todo)
        return out

    def subtrees(self):
        """(size, leaves) of the subtree of every node, in preorder."""
        close = self.findclose(self.opens)
        return (close - self.opens + 1) // 2, self.pairs[close] - self.pairs[self.opens]
