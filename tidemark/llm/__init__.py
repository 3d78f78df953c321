"""Training-data operators: media, HTML, chat, quality, secrets, packing, LM scores, WARC, near-dups, mixing."""
