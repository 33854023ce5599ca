"""Operators on the texts of a crawl: token ids, packing into containers, spam pages."""
