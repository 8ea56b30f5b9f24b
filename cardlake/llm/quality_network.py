"""Quality of texts by a convolutional network over their bytes, in numpy.

A byte becomes a learned vector, beside a channel that says whether its word equals the one before. Learned filters of
``WIDTH`` bytes pass over the whole text, ``STRIDE`` bytes at a time. Their responses are averaged over chunks of
``2 * BLOCK`` bytes, which overlap by half and cover the text from its first byte to its last; of every filter the
largest chunk counts, and a logistic unit combines them into one probability.

The network is fitted by Adam on at most ``MAX_LABELLED`` labelled documents of ``MAX_BYTES`` bytes together, those with
the smallest hashes of their ids, whole texts; a document beyond the bytes that are left, and what follows it, is not
used for fitting. The sample is the one thing that comes to the driver. Scores cover every text.

Null and empty texts are scored as padding alone. Rows that repeat are scored one by one and extra columns are carried
by :func:`scored`. Of several labels of one document the mean decides, a tie is good. A null id is never learned from.
Where all usable labels are alike every score is that label, without usable labels 0. Texts of any length are scored
whole, in slices of bounded memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.llm.common import ship, text_of
from cardlake.llm.toxicity import bucket

THRESHOLD = 0.7
MAX_LABELLED, MAX_BYTES = 2500, 10_000_000
WIDTH, STRIDE, CHANNELS, FILTERS = 8, 2, 8, 16
BLOCK = 64
# Of fitting: documents and bytes of a step, steps, rate.
STEP_DOCS, STEP_BYTES, EPOCHS, LEAST_STEPS, RATE = 48, 400_000, 4, 120, 0.01
# Bytes that go through the filters together, and bytes of texts of one call; results do not depend on them.
SLICE, GROUP_BYTES = 1 << 17, 1 << 20
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
PLACES = BLOCK // STRIDE


def repeats(text: bytes) -> np.ndarray:
    """For every byte whether its word equals the one before it."""
    words = text.translate(_SPACES).split(b" ")
    same = np.fromiter((a == b != b"" for a, b in zip(words[1:], words)), bool, len(words) - 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.repeat(np.append(False, same), lengths + 1)[: len(text)]


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and repeats of all texts, each in whole blocks, at least two; and the blocks of each text.

    Every text follows WIDTH zeros, so that no place of a filter reads two texts.
    """
    blocks = np.array([max(2, -(-(len(text) + WIDTH) // BLOCK)) for text in texts], np.int64)
    data, same = np.zeros(int(blocks.sum()) * BLOCK, np.uint8), np.zeros(int(blocks.sum()) * BLOCK, np.float32)
    for start, text in zip((np.cumsum(blocks) - blocks) * BLOCK + WIDTH, texts):
        data[start : start + len(text)] = np.frombuffer(text, np.uint8)
        same[start : start + len(text)] = repeats(text)
    return data, same, blocks


@dataclass
class Network:
    """The learned vectors of bytes, filters and the unit that combines them; without filters one constant score."""

    vectors: np.ndarray  # 256 x (CHANNELS - 1)
    filters: np.ndarray  # WIDTH * CHANNELS x FILTERS
    offsets: np.ndarray
    weights: np.ndarray
    constant: np.ndarray
    fixed: float | None = None

    @classmethod
    def start(cls, seed: int = 11) -> Network:
        """Vectors with the kind of a byte and noise, random filters."""
        random = np.random.Generator(np.random.PCG64(seed))
        draw = lambda scale, *shape: (scale * random.standard_normal(shape)).astype(np.float32)
        vectors = draw(0.3, 256, CHANNELS - 1)
        for code in range(256):
            char = chr(code)
            kinds = (char.isspace(), code < 128 and char.isupper(), code < 128 and char.islower(), char.isdigit(), 32 < code < 127 and not char.isalnum(), code > 127)
            vectors[code, : len(kinds)] += np.array(kinds, np.float32)
        vectors[0] = 0
        return cls(vectors, draw(0.5 / np.sqrt(WIDTH), WIDTH * CHANNELS, FILTERS), draw(0.05, FILTERS), draw(0.3, FILTERS), np.zeros(1, np.float32))

    def windows(self, data: np.ndarray, same: np.ndarray) -> np.ndarray:
        """The input of every place of a filter; after the end come zero bytes."""
        rows = np.zeros((len(data) + WIDTH, CHANNELS), self.vectors.dtype)
        rows[:, :-1] = self.vectors[np.append(data, np.zeros(WIDTH, np.uint8))]
        rows[: len(data), -1] = same
        flat = rows.ravel()
        places = len(data) // STRIDE
        view = np.lib.stride_tricks.as_strided(flat, (places, WIDTH * CHANNELS), (STRIDE * CHANNELS * flat.itemsize, flat.itemsize))
        return np.ascontiguousarray(view)

    def block_means(self, data: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Mean response of every filter in every block."""
        found = []
        for start in range(0, len(data), SLICE):
            # A slice reads on to the bytes of the next one, so that no place is cut.
            end = min(start + SLICE, len(data))
            windows = self.windows(data[start : end + BLOCK], same[start : end + BLOCK])[: (end - start) // STRIDE]
            response = np.maximum(windows @ self.filters + self.offsets, 0)
            found.append(response.reshape(-1, PLACES, response.shape[1]).mean(1))
        return np.concatenate(found)

    def pooled(self, data: np.ndarray, same: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Each text's largest chunk by filter. The last chunk of a text has no successor, so the next text's is left out."""
        means = self.block_means(data, same)
        chunks = (means[:-1] + means[1:]) / 2
        firsts = np.cumsum(blocks) - blocks
        # Chunks over the border of two texts count as less than any other.
        chunks[firsts[1:] - 1] = -1
        return np.maximum.reduceat(chunks, firsts)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(texts), self.fixed)
        found, start, size = [np.empty(0)], 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size > GROUP_BYTES or end == len(texts):
                z = self.pooled(*laid_out(texts[start:end])) @ self.weights + self.constant
                found.append(1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30))))
                start, size = end, 0
        return np.concatenate(found)

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        """Of the log loss, by the parameters. Only a filter's largest chunk in each text passes it on."""
        data, same, blocks = laid_out(texts)
        means = self.block_means(data, same)
        chunks, firsts = (means[:-1] + means[1:]) / 2, np.cumsum(blocks) - blocks
        best = np.stack([first + chunks[first : first + n - 1].argmax(0) for first, n in zip(firsts, blocks)])
        peak = chunks[best, np.arange(FILTERS)]
        p = 1 / (1 + np.exp(-np.clip(peak @ self.weights + self.constant, -30, 30)))
        error = ((p - labels) / len(texts)).astype(np.float32)
        to_chunk = error[:, None] * self.weights / (2 * PLACES)
        # All places of the chosen chunks: by filter, text and place.
        places = best.T[:, :, None] * PLACES + np.arange(2 * PLACES)
        spots = places[..., None] * STRIDE + np.arange(WIDTH)
        data, same = np.append(data, np.zeros(WIDTH, np.uint8)), np.append(same, np.zeros(WIDTH, np.float32))
        codes = data[spots]
        windows = np.concatenate([self.vectors[codes], same[spots][..., None]], -1).reshape(FILTERS, -1, WIDTH * CHANNELS)
        active = np.matmul(windows, self.filters.T[:, :, None])[..., 0] + self.offsets[:, None] > 0
        down = np.where(active, np.repeat(to_chunk.T, 2 * PLACES, axis=1), 0)
        to_filters = np.matmul(down[:, None, :], windows)[:, 0].T
        back = (down[..., None] * self.filters.T[:, None, :]).reshape(-1, CHANNELS)
        to_vectors = np.stack([np.bincount(codes.ravel(), back[:, c], 256) for c in range(CHANNELS - 1)], 1)
        return [to_vectors, to_filters, down.sum(1), peak.T @ error, np.array([error.sum()])]

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.offsets, self.weights, self.constant]


def _batches(order: np.ndarray, texts: list[bytes]):
    some, size = [], 0
    for i in order.tolist():
        if some and (len(some) == STEP_DOCS or size + len(texts[i]) > STEP_BYTES):
            yield some
            some, size = [], 0
        some.append(i)
        size += len(texts[i])
    yield some


def trained(texts: list[bytes], labels: np.ndarray) -> Network:
    """A network fitted by Adam; the same texts and labels in the same order give the same network."""
    network = Network.start()
    if not len(texts) or labels.min() == labels.max():
        network.fixed = float(labels.max()) if len(texts) else 0.0
        return network
    network.constant[0] = np.log(labels.mean() / (1 - labels.mean()))
    random = np.random.Generator(np.random.PCG64(5))
    first = [np.zeros_like(p) for p in network.parameters()]
    second = [np.zeros_like(p) for p in network.parameters()]
    step, epoch = 0, 0
    while epoch < EPOCHS or step < LEAST_STEPS:
        for batch in _batches(random.permutation(len(texts)), texts):
            step += 1
            found = network.gradients([texts[i] for i in batch], labels[batch])
            for p, g, m, v in zip(network.parameters(), found, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        epoch += 1
    return network


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_bytes: int = MAX_BYTES) -> DataFrame:
    """h, good and text of the labelled sample."""
    one = labels.filter("doc_id is not null and quality is not null").filter(bucket() != 2).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    some = one.select(F.col("doc_id").alias("labelled_id"), "good", F.xxhash64("doc_id").alias("h")).orderBy("h", "labelled_id").limit(most)
    text = text_of("text")
    # Bounded by ``most`` rows of a few bytes.
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("size")).join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id"))
    # Rows that repeat an id do not widen the sample.
    rows = rows.filter(F.col("size") <= most_bytes).select("h", "good", "size", F.xxhash64("text").alias("t"), "text")
    first = rows.select("h", "size", "t").orderBy("h", "size", "t").limit(most).collect()
    total, last = np.cumsum([r["size"] for r in first]), None
    for r, bytes_so_far in zip(first, total):
        if bytes_so_far > most_bytes:
            break
        last = r
    if last is None:
        return rows.filter("false").select("h", "good", "text")
    within = F.struct("h", "size", "t") <= F.struct(*(F.lit(last[c]).cast("long").alias(c) for c in ("h", "size", "t")))
    return rows.filter(within).orderBy("h", "size", "t").limit(most).select("h", "good", "text")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Network:
    """Learn from documents whose ids are not held out. Ids, languages and sources are not read as inputs."""
    # At most ``most`` rows of MAX_BYTES together.
    rows = labelled(docs, labels, most).collect()
    return trained([r["text"].encode() for r in rows], np.array([r["good"] for r in rows], np.float32))


def scored(docs: DataFrame, network: Network, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability that each text is good."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts):
        return pd.Series(network.scores([text.encode() for text in texts]))

    return docs.withColumn(column, score(text_of("text")))
