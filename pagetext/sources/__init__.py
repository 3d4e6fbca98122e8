"""Archives, images and OCR engines as table functions."""
