"""Settings of the sequence analytics. The values under 'fixed values' have to be these for right results; the rest are defaults."""

# Inclusive 1-based ranges of the sites of interest; overlaps count more than once.
SITE_RANGES = [
    (194, 210), (291, 325), (307, 323), (371, 387), (410, 426), (525, 566), (530, 544), (722, 739),
    (747, 763), (749, 771), (754, 770), (891, 906), (897, 913), (1101, 1115), (1129, 1145), (1213, 1229),
]
# Number of clusters for each monthly period.
PERIOD_CLUSTERS = {
    "2020-2": 2, "2020-3": 2, "2020-4": 2, "2020-5": 2, "2020-6": 2, "2020-7": 3, "2020-8": 3, "2020-9": 4,
    "2020-10": 4, "2020-11": 5, "2020-12": 6, "2021-1": 7, "2021-2": 8, "2021-3": 8, "2021-4": 8, "2021-5": 9,
    "2021-6": 10, "2021-7": 11, "2021-8": 11, "2021-9": 12, "2021-10": 14, "2021-11": 15, "2021-12": 16,
}

AMBIGUOUS = "BJZX-"
TERMINATOR = "*"
LENGTH_BOUNDS = (1260, 1280)
PREFERRED_LENGTH = 1274
BATCH_RECORDS, START_RECORD, MOST_BATCHES = 50_000, 6_500_000, 20
WINDOW_SIZE = 10
DATASET_ROWS = 634_000
DIFFERENCE_SHARE = 0.5
ATTEMPTS = 11
MOST_ROUNDS = 255
UNIQUE_RATIO = 0.2
VECTOR_WIDTH = 100


def site_positions() -> list[int]:
    """0-based site positions in order, overlaps kept."""
    return [p - 1 for a, b in SITE_RANGES for p in range(a, b + 1)]
