"""Column functions: text clean-up, segmentation, extraction and keys, all from built-in expressions but for NFC."""
