"""Spark jobs for labelled-imagery curation and parcel classification."""
