"""Turn tables and streams of crawled web pages into article, media and book tables on Spark."""
