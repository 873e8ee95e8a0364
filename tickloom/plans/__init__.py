"""Jobs over tables of compiled strategy plans."""
