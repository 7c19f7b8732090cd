"""issuelens: keyword labelling, keyword extraction and active learning on Spark."""
