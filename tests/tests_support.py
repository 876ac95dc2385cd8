"""Synthetic images."""

import numpy as np


def scene(w, h, variant=0):
    y, x = np.mgrid[0:h, 0:w]
    img = x * 90 // (w - 1) + y * 90 // (h - 1)
    x0 = w // 8 + variant * (w // 6)
    img[h // 8 : h // 8 + h // 4, x0 : x0 + w // 4] = 220
    return img.astype(np.uint8)


def brighter(img, by):
    return np.minimum(img.astype(int) + by, 255).astype(np.uint8)


def noisy(img, amplitude, seed):
    out, state = [], seed
    for p in img.reshape(-1):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(min(255, max(0, int(p) + (state >> 16) % (2 * amplitude + 1) - amplitude)))
    return np.array(out, np.uint8).reshape(img.shape)


def blurred(img, passes):
    img = img.astype(int)
    for _ in range(passes):
        out = img.copy()
        out[1:-1, 1:-1] = (img[1:-1, 1:-1] + img[:-2, 1:-1] + img[2:, 1:-1] + img[1:-1, :-2] + img[1:-1, 2:]) // 5
        img = out
    return img.astype(np.uint8)
