"""A one-layer causal self-attention language model over subword ids, in numpy.

A token's query, key and value are rows of tables (embedding times projection), and
attention adds a learned bias per distance, so a stream is scored by table rows and
batched products.  The next token is drawn in two steps: its class by a softmax over
the attention output and the current token's embedding, then the token in its class
by counts of the whole training corpus, which makes the probabilities of all tokens
sum to one.

A stream is cut into blocks of STRIDE tokens.  A block's window is the block and the
STRIDE tokens before it: windows overlap, and every token is scored once, with at
least STRIDE tokens of context where its document has them.  A mask keeps attention
causal and inside the document.

Where ONNX Runtime is installed, windows in single precision go through its kernels
(``Loops``); the numpy form beside it is the same arithmetic.
"""

from __future__ import annotations

import functools

import numpy as np

from sitegraph.llm.graphs import Graph, installed

STRIDE = 16
SPAN = 2 * STRIDE
WIDTH = 16
CLASSES = 192
CHUNK = 128                     # windows per batch
ROWS = 512                      # positions whose class scores are held at once: they stay in the cache
_I, _J = np.arange(STRIDE)[:, None] + STRIDE, np.arange(SPAN)[None, :]
DISTANCE = np.clip(_I - _J, 0, SPAN - 1)
CAUSAL = np.where(_J <= _I, 0, -1e9).astype(np.float32)

Weights = dict[str, np.ndarray]


def start_weights(classes: np.ndarray, seed: int = 7) -> Weights:
    """``classes``: the class of every token; the last token begins a text."""
    r = np.random.default_rng(seed)
    by_class = r.normal(0, 0.5, (CLASSES, WIDTH))
    g = lambda *s: (r.normal(0, 1, s) / np.sqrt(WIDTH)).astype(np.float32)
    return {"e": (by_class[classes] + r.normal(0, 0.05, (len(classes), WIDTH))).astype(np.float32),
            "q": g(WIDTH, WIDTH), "k": g(WIDTH, WIDTH), "v": g(WIDTH, WIDTH), "d": np.zeros(SPAN, np.float32),
            "a": 0.3 * g(WIDTH, CLASSES), "o": 0.3 * g(WIDTH, CLASSES), "b": np.zeros(CLASSES, np.float32)}


def windows(stream: np.ndarray, fill: int) -> np.ndarray:
    """The overlapping windows of a stream (n_blocks x SPAN), ``fill`` before and after it."""
    blocks = -(-len(stream) // STRIDE)
    padded = np.full((blocks + 1) * STRIDE, fill, stream.dtype)
    padded[STRIDE:STRIDE + len(stream)] = stream
    return np.lib.stride_tricks.sliding_window_view(padded, SPAN)[::STRIDE]


def document_mask(text: np.ndarray) -> np.ndarray | None:
    """For windows of text numbers: -1e9 where a key is of another document."""
    return np.where(text[:, STRIDE:, None] == text[:, None, :], 0, -1e9).astype(np.float32)


def _folded(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Query and key projection as one matrix, and the matrix that gives the class logits of
    (attended embedding, own embedding, one): products of the weights, so that keys and
    values are the embeddings themselves and no window is projected."""
    root = np.asarray(1 / np.sqrt(WIDTH), w["q"].dtype)
    return w["q"] @ w["k"].T * root, np.concatenate([w["v"] @ w["a"], w["o"], w["b"][None]])


def _within_reach(z: np.ndarray) -> np.ndarray:
    """Logits to base 2, changed in place so that powers of them are finite and a row's sum
    above 0: less the row's maximum, which no softmax sees, but only where values are large."""
    if not (z.max() < 80 and z.min() > -80):
        z -= z.max(axis=-1, keepdims=True)
    return z


def _overlapping(rows: np.ndarray) -> np.ndarray:
    """Windows of SPAN consecutive ``rows``, one for each STRIDE (a view)."""
    step, width = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (len(rows) // STRIDE - 1, SPAN, rows.shape[1]),
                                           (STRIDE * step, step, width), writeable=False)


class Loops:
    """Forward and backward pass over CHUNK windows in ONNX Runtime, over buffers that stay:
    a batch of less leaves the rest as it was, and its results are cut off."""

    def __init__(self):
        n, m, f = CHUNK, CHUNK * STRIDE, np.float32
        shapes = {"rows": (n, SPAN, WIDTH), "bias": (n, STRIDE, SPAN), "one": (n, STRIDE, 1), "query": (WIDTH, WIDTH),
                  "head": (2 * WIDTH + 1, CLASSES), "cur": (n, STRIDE, WIDTH), "q": (n, STRIDE, WIDTH), "p": (n, STRIDE, SPAN),
                  "att": (n, STRIDE, WIDTH), "x": (m, 2 * WIDTH + 1), "z": (m, CLASSES), "back": (CLASSES, 2 * WIDTH),
                  "turned": (WIDTH, WIDTH), "g_head": (2 * WIDTH + 1, CLASSES), "g_bias": (STRIDE, SPAN),
                  "g_query": (WIDTH, WIDTH), "de": (n, SPAN, WIDTH), "own": (n, STRIDE, WIDTH)}
        self.at = {k: np.zeros(s, f) for k, s in shapes.items()}
        self.at["one"][:] = 1
        inputs, kept = ["rows", "bias", "one", "query", "head"], ["cur", "q", "p", "att", "x"]
        self.first = CLASSES * np.arange(m)
        self.scores = self._bound(self._forward("LogSoftmax"), inputs, ["z"])
        self.forward = self._bound(self._forward("Softmax"), inputs, [*kept, "z"])
        self.backward = self._bound(self._backward(), ["rows", *kept, "z", "back", "turned"],
                                    ["g_head", "g_bias", "g_query", "de", "own"])

    def _bound(self, g: Graph, inputs: list[str], outputs: list[str]):
        session = g.session(inputs, outputs)
        binding = session.io_binding()
        for bind, names in ((binding.bind_input, inputs), (binding.bind_output, outputs)):
            for k in names:
                bind(k, "cpu", 0, np.float32, self.at[k].shape, self.at[k].ctypes.data)
        return lambda: session.run_with_iobinding(binding)

    @staticmethod
    def _forward(softmax: str) -> Graph:
        g = Graph()
        cur = g("Slice", "rows", g.constant(STRIDE), g.constant(SPAN), g.constant(1), to="cur")
        q = g("MatMul", cur, "query", to="q")
        p = g("Softmax", g("Add", g("FusedMatMul", q, "rows", own=True, transB=1), "bias"), to="p", axis=2)
        att = g("MatMul", p, "rows", to="att")
        x = g("Reshape", g("Concat", att, cur, "one", axis=2), g.constant(-1, 2 * WIDTH + 1), to="x")
        g(softmax, g("MatMul", x, "head"), to="z", axis=1)
        return g

    @staticmethod
    def _backward() -> Graph:
        """From ``z``, the gradient of the class logits, on."""
        g = Graph()
        g("FusedMatMul", "x", "z", to="g_head", own=True, transA=1)
        dx = g("Reshape", g("MatMul", "z", "back"), g.constant(-1, STRIDE, 2 * WIDTH))
        dh, own = (g("Slice", dx, g.constant(k), g.constant(k + WIDTH), g.constant(2)) for k in (0, WIDTH))
        off = g("ReduceSum", g("Mul", dh, "att"), g.constant(2), keepdims=1)
        ds = g("Mul", "p", g("Sub", g("FusedMatMul", dh, "rows", own=True, transB=1), off))
        g("ReduceSum", ds, g.constant(0), to="g_bias", keepdims=0)
        dq, narrow = g("MatMul", ds, "rows"), g.constant(-1, WIDTH)
        g("FusedMatMul", g("Reshape", "cur", narrow), g("Reshape", dq, narrow), to="g_query", own=True, transA=1)
        g("FusedMatMul", g("Concat", ds, "p", axis=1), g("Concat", "q", dh, axis=1), to="de", own=True, transA=1)
        g("Add", own, g("MatMul", dq, "turned"), to="own")
        return g

    def weights(self, w: Weights) -> None:
        self.at["query"][:], self.at["head"][:] = _folded(w)
        self.at["back"][:], self.at["turned"][:] = self.at["head"][:-1].T, self.at["query"].T
        self.e, self.base = w["e"], w["d"][DISTANCE] + CAUSAL

    def windows(self, ids: np.ndarray, texts: np.ndarray) -> None:
        n, bias = len(ids), self.at["bias"]
        self.e.take(ids, axis=0, out=self.at["rows"][:n], mode="clip")
        bias[:] = self.base
        mixed = np.flatnonzero((texts != texts[:, -1:]).any(axis=1))
        if len(mixed):
            bias[mixed] += document_mask(texts[mixed])

    def gradient(self, w: Weights, ids: np.ndarray, texts: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> tuple[float, Weights]:
        self.weights(w)
        z, total, loss = self.at["z"], max(float(weight.sum()), 1.0), 0.0
        sums = {k: np.zeros_like(self.at[k]) for k in ("g_head", "g_query", "g_bias")}
        de = self.at["de"] if len(ids) <= CHUNK else np.empty((len(ids), SPAN, WIDTH), np.float32)
        for lo in range(0, len(ids), CHUNK):
            part, own = ids[lo:lo + CHUNK], weight[lo:lo + CHUNK].ravel()
            self.windows(part, texts[lo:lo + CHUNK])
            self.forward()
            m = len(own)
            at = self.first[:m] + goal[lo:lo + CHUNK].ravel()
            loss -= float(own @ np.log(z.ravel().take(at) + 1e-12))
            z.ravel()[at] -= 1
            z[m:] = 0
            other = np.flatnonzero(own != 1)
            if len(other):
                z[other] *= own[other, None]
            self.backward()
            for k in sums:
                sums[k] += self.at[k]
            self.at["de"][:, STRIDE:] += self.at["own"]
            if de is not self.at["de"]:
                de[lo:lo + CHUNK] = self.at["de"][:len(part)]
        g = _gradients(w, ids, de[:len(ids)], sums["g_head"], sums["g_query"], sums["g_bias"])
        for k in g.keys() - {"e_rows"}:
            g[k] = g[k] * np.float32(1 / total)
        return loss / total, g

    def score(self, ids: np.ndarray, texts: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Log-probability of the class ``goal`` at every position, of the weights set before."""
        out = np.empty(len(goal), np.float32)
        for lo in range(0, len(ids), CHUNK):
            self.windows(ids[lo:lo + CHUNK], texts[lo:lo + CHUNK])
            self.scores()
            place = slice(lo * STRIDE, (lo + CHUNK) * STRIDE)
            own = goal[place]
            out[place] = self.at["z"].ravel().take(self.first[:len(own)] + own)
        return out


@functools.cache
def loops() -> Loops | None:
    """This process's ``Loops``, if it has ONNX Runtime."""
    return Loops() if installed() else None


class Scorer:
    """Log-probabilities (natural) of class and token for whole streams."""

    def __init__(self, w: Weights, classes: np.ndarray, log_within: np.ndarray, fast: bool = True):
        e = w["e"]
        self.w, self.loops = w, loops() if fast else None
        query, self.head = _folded(w)
        # a last column of ones: its attention sum is the softmax denominator
        self.table = np.concatenate([e @ query, e, np.ones((len(e), 1), np.float32)], axis=1)
        self.head *= np.float32(np.log2(np.e))      # logits to base 2: the faster power
        self.bias = w["d"][DISTANCE] + CAUSAL
        self.classes, self.log_within = classes, log_within

    def score(self, stream: np.ndarray, text: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of every position of ``stream`` (tokens; ``text``: number of its document) the
        log-probability of ``target``."""
        n = len(stream)
        ids, texts = windows(stream, 0), windows(text, -1)
        out, mass = np.empty((2, len(ids) * STRIDE), np.float32)
        goal = np.zeros(len(out), np.int64)
        goal[:n] = self.classes[target]
        if self.loops:
            self.loops.weights(self.w)
            return self.loops.score(ids, texts, goal)[:n] + self.log_within[target]
        x = np.empty((CHUNK * STRIDE, 2 * WIDTH + 1), np.float32)
        buffer, ones, first = np.empty((ROWS, CLASSES), np.float32), np.ones(CLASSES, np.float32), CLASSES * np.arange(ROWS)
        for at in range(0, len(ids), CHUNK):
            part, t = ids[at:at + CHUNK], texts[at:at + CHUNK]
            # the tokens of these windows in a row: windows overlap, so each is looked up once
            rows = self.table.take(np.concatenate([part[0, :STRIDE], part[:, STRIDE:].ravel()]), axis=0)
            query, keys, own = rows[STRIDE:, :WIDTH], rows[:, WIDTH:-1], rows[STRIDE:, WIDTH:]
            scores = query.reshape(-1, STRIDE, WIDTH) @ _overlapping(keys).transpose(0, 2, 1)
            scores += self.bias
            mixed = np.flatnonzero((t != t[:, -1:]).any(axis=1))      # a stream of one block is filled at both ends
            if len(mixed):
                scores[mixed] += document_mask(t[mixed])
            np.minimum(scores, 80, out=scores)      # exp stays finite; a row's own token is never masked
            np.exp(scores, out=scores)
            seen = (scores @ _overlapping(rows[:, WIDTH:])).reshape(-1, WIDTH + 1)
            m = len(seen)
            np.multiply(seen[:, :WIDTH], 1 / seen[:, WIDTH:], out=x[:m, :WIDTH])
            x[:m, WIDTH:] = own
            for lo in range(0, m, ROWS):
                hi = min(lo + ROWS, m)
                z = _within_reach(np.matmul(x[lo:hi], self.head, out=buffer[:hi - lo]))
                place = slice(at * STRIDE + lo, at * STRIDE + hi)
                out[place] = z.ravel().take(first[:hi - lo] + goal[place])
                np.exp2(z, out=z)
                mass[place] = z @ ones
        out -= np.log2(mass)
        out *= np.float32(np.log(2))
        return out[:n] + self.log_within[target]


def gradient(w: Weights, ids: np.ndarray, texts: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> tuple[float, Weights]:
    """Mean loss (class cross-entropy) of a batch of windows and its gradient.

    ``goal``, ``weight``: class to predict and weight per block position."""
    if w["e"].dtype == np.float32 and loops():
        return loops().gradient(w, ids, texts, goal, weight)
    return plain_gradient(w, ids, texts, goal, weight)


def _gradients(w: Weights, ids: np.ndarray, de: np.ndarray, g_head: np.ndarray, g_query: np.ndarray, g_bias: np.ndarray) -> Weights:
    """Gradients of the weights from those of the embeddings at every place of ``ids``, of the
    folded matrices and of the score biases."""
    kind, g_query = de.dtype, g_query * np.asarray(1 / np.sqrt(WIDTH), de.dtype)
    g = {"a": w["v"].T @ g_head[:WIDTH], "v": g_head[:WIDTH] @ w["a"].T, "o": g_head[WIDTH:-1], "b": g_head[-1],
         "q": g_query @ w["k"], "k": g_query.T @ w["q"],
         "d": np.bincount(DISTANCE.ravel(), g_bias.ravel(), SPAN).astype(kind)}
    # token and place in one number: a plain sort brings the places of a token together
    bits = ids.size.bit_length()
    keys = np.sort((ids.ravel().astype(np.int64) << bits) + np.arange(ids.size))
    token, place = keys >> bits, keys & ((1 << bits) - 1)
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    g["e_rows"], g["e"] = token[starts], np.add.reduceat(de.reshape(-1, WIDTH).take(place, axis=0), starts, axis=0)
    return g


def plain_gradient(w: Weights, ids: np.ndarray, texts: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> tuple[float, Weights]:
    """``gradient`` in numpy.  The wide arrays of a softmax stay as exponentials; its
    denominators divide the narrow arrays beside."""
    kind, n = w["e"].dtype, len(ids)
    flat = lambda x: x.reshape(-1, x.shape[-1])
    query, head = _folded(w)
    e = np.ones((n, SPAN, WIDTH + 1), kind)         # embeddings and a one
    e[..., :-1] = w["e"].take(ids, axis=0)
    keys = e[..., :-1]
    x = np.empty((n * STRIDE, 2 * WIDTH + 1), kind)     # attended embedding, own embedding, one
    x[:, WIDTH:] = flat(e[:, STRIDE:])
    cur = x[:, WIDTH:-1]
    q = (cur @ query).reshape(n, STRIDE, WIDTH)
    pair = np.empty((n, SPAN, SPAN), kind)          # per query: gradients of its scores; their exponentials
    ds, p = pair[:, :STRIDE], pair[:, STRIDE:]
    np.matmul(q, keys.transpose(0, 2, 1), out=p)
    p += (w["d"][DISTANCE] + CAUSAL).astype(kind)
    mixed = np.flatnonzero((texts != texts[:, -1:]).any(axis=1))
    if len(mixed):
        p[mixed] += document_mask(texts[mixed])
    own = p.diagonal(STRIDE, 1, 2)                  # a row's own token is never masked
    if not (p.max() < 60 and own.min() > -60):      # else exponentials are fine as they are
        p -= p.max(axis=-1, keepdims=True)
    np.exp(p, out=p)
    seen = flat(p @ e)
    below = 1 / seen[:, WIDTH:]
    np.multiply(seen[:, :-1], below, out=x[:, :WIDTH])

    total = max(float(weight.sum()), 1.0)
    share, goal = (weight.ravel() / total).astype(kind), goal.ravel()
    g_head, dx = np.zeros_like(head), np.empty((len(x), 2 * WIDTH), kind)
    right, mass = np.empty((2, len(x)), kind)
    head2, back = head * np.asarray(np.log2(np.e), kind), head[:-1].T     # to base 2: the faster power
    buffer, ones, first = np.empty((min(ROWS, len(x)), CLASSES), kind), np.ones(CLASSES, kind), CLASSES * np.arange(ROWS)
    for lo in range(0, len(x), ROWS):
        hi = min(lo + ROWS, len(x))
        z = _within_reach(np.matmul(x[lo:hi], head2, out=buffer[:hi - lo]))
        np.exp2(z, out=z)
        at = first[:hi - lo] + goal[lo:hi]
        right[lo:hi], mass[lo:hi] = z.ravel().take(at), z @ ones
        z.ravel()[at] -= mass[lo:hi]
        part = share[lo:hi] / mass[lo:hi]
        g_head[-1] += part @ z
        g_head[:-1] += (z.T @ (x[lo:hi, :-1] * part[:, None])).T
        np.multiply(z @ back, part[:, None], out=dx[lo:hi])
    loss = -float((share * np.log(right / mass + 1e-12)).sum())
    dh = dx[:, :WIDTH]

    # with the one: what a score's gradient takes off is the product of dh and the attended embedding
    to = np.empty((n, STRIDE, WIDTH + 1), kind)
    np.multiply(dh, below, out=flat(to)[:, :-1])
    np.einsum("ij,ij->i", flat(to)[:, :-1], x[:, :WIDTH], out=flat(to)[:, -1])
    np.negative(to[..., -1], out=to[..., -1])
    np.matmul(to, e.transpose(0, 2, 1), out=ds)
    ds *= p
    dq = flat(ds @ keys)
    de = pair.transpose(0, 2, 1) @ np.concatenate([q, to[..., :-1]], axis=1)
    de[:, STRIDE:] += (dx[:, WIDTH:] + dq @ query.T).reshape(n, STRIDE, WIDTH)
    return loss, _gradients(w, ids, de, g_head, cur.T @ dq, ds.sum(axis=0))


class Trainer:
    """Adam over batches of windows; embedding rows are updated where they occur."""

    def __init__(self, w: Weights):
        self.w = {n: x.copy() for n, x in w.items()}
        self.m, self.s = ({n: np.zeros_like(x) for n, x in w.items()} for _ in range(2))
        self.steps = 0

    def step(self, lr: float, *batch: np.ndarray) -> float:
        loss, g = gradient(self.w, *batch)
        self.steps += 1
        for n in self.w:
            w, m, s, d = self.w[n], self.m[n], self.s[n], g[n]
            if n == "e":
                w, m, s = (x.take(g["e_rows"], axis=0) for x in (w, m, s))
            m *= 0.9
            m += 0.1 * d
            s *= 0.99
            s += 0.01 * d * d
            move = np.sqrt(s)
            move += 1e-6
            np.divide(m, move, out=move)
            move *= lr
            w -= move
            if n == "e":
                for x, rows in ((self.w, w), (self.m, m), (self.s, s)):
                    x[n][g["e_rows"]] = rows
        return loss


def train(w: Weights, ids: np.ndarray, texts: np.ndarray, goal: np.ndarray, weight: np.ndarray, epochs: int = 1,
          rate: float = 0.01, batch: int = 128, seed: int = 3) -> tuple[Weights, list[float]]:
    """Training over shuffled windows that are all at hand."""
    trainer, r, losses = Trainer(w), np.random.default_rng(seed), []
    total = max(1, epochs * -(-len(ids) // batch))
    for _ in range(epochs):
        order = r.permutation(len(ids))
        for at in range(0, len(order), batch):
            pick, step = order[at:at + batch], trainer.steps + 1
            lr = rate * min(1.0, 10 * (1 - step / (total + 1)), step / 20)
            losses.append(trainer.step(lr, ids[pick], texts[pick], goal[pick], weight[pick]))
    return trainer.w, losses


def train_stream(w: Weights, parts, rate: float, batch: int = 128, seed: int = 3) -> tuple[Weights, int]:
    """Training over ``parts`` (arrays as ``train`` takes them) as they come, once each and
    shuffled within a part: only one is held.  The rate falls with the root of the steps,
    for their number is not known.  Returns the number of windows too."""
    trainer, r, n = Trainer(w), np.random.default_rng(seed), 0
    for part in parts:
        order = r.permutation(len(part[0]))
        n += len(order)
        for at in range(0, len(order), batch):
            pick, step = order[at:at + batch], trainer.steps + 1
            trainer.step(rate * min(step / 20, (200 / max(step, 200)) ** 0.5, 1.0), *[x[pick] for x in part])
    return trainer.w, n
