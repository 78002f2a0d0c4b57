"""Binary tree convolution with dynamic max-pooling, in numpy."""

from __future__ import annotations

import numpy as np


class TreeError(ValueError):
    """A tree that is not (features,) or (features, left, right)."""


def flatten(tree, features) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, triples): node vectors in preorder after a zero row, and (self, left, right) places; 0 stands for no child."""
    nodes, triples = [], []

    def walk(t) -> int:
        if not isinstance(t, tuple) or len(t) not in (1, 2, 3) or len(t) == 2 and not isinstance(t[0], tuple) and isinstance(t[1], tuple):
            raise TreeError(f"not a tree: {t!r}")
        leaf = len(t) != 3 or not isinstance(t[0], tuple)
        value = t if leaf and not isinstance(t[0], tuple) else t[0]
        nodes.append(np.asarray(features(value), dtype=float))
        me = len(nodes)
        triples.append([me, 0, 0])
        if len(t) == 3 and isinstance(t[0], tuple):
            triples[me - 1][1], triples[me - 1][2] = walk(t[1]), walk(t[2])
        return me

    walk(tree)
    return np.vstack([np.zeros_like(nodes[0]), *nodes]), np.array(triples)


def convolve(nodes: np.ndarray, triples: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """weight: (out, 3 * in); the zero row stays zero."""
    out = nodes[triples].reshape(len(triples), -1) @ weight.T + bias
    return np.vstack([np.zeros(out.shape[1]), out])


def layer_norm(nodes: np.ndarray) -> np.ndarray:
    spread = nodes.std() or 1.0
    return (nodes - nodes.mean()) / (spread + 1e-5)


def relu(nodes: np.ndarray) -> np.ndarray:
    return np.maximum(nodes, 0.0)


def pool(nodes: np.ndarray) -> np.ndarray:
    return nodes.max(axis=0)
